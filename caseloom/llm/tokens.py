"""Token ids of whole texts by the tokenizers library, with a memo of pre-tokens.

Both vocabularies cut a text into pre-tokens by a pattern and merge inside each
of them alone, so the library's ids of the pre-tokens, put together, are its
ids of the whole text.  A pre-token that the memo lacks goes to the library's
model.  A text with characters outside ``PLAIN``, or with a special token's
string, goes to the library whole: there the library's own tables decide.

The memo has two generations.  When the younger one is full it becomes the
older one, whose entries come back when they are met again: frequent
pre-tokens stay, and a worker holds at most ``MEMO_ENTRIES``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from struct import pack
from typing import Any

import numpy as np

from ._common import kept

#: Bound of both generations together: some 80 MB.
MEMO_ENTRIES = 500_000
#: Longer pre-tokens are not kept.
MEMO_CHARS = 48

# Within PLAIN these classes are the Unicode letters, numbers and white space.
_L = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_N = "0-9²³¹¼-¾"
_S = "\t\n\r "
#: Texts that the patterns below may cut: common western characters.
PLAIN = re.compile(rf"[^\t\n\r -~¡-įı-ſ‐-‧‰-⁞]|<\|")
_PLAIN_BYTES = bytes(b for b in range(256) if not PLAIN.search(chr(b)))

_BYTE_LEVEL = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_LEVEL = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


_SYMBOL_OF = dict(enumerate(byte_symbols()))


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN_BYTES) and "<|" not in text
    except UnicodeEncodeError:
        return PLAIN.search(text) is None


def byte_level_parts(text: str) -> list[str]:
    """Pre-tokens of a plain text for the byte-level vocabularies."""
    return _BYTE_LEVEL.findall(text)


class Memo(dict):
    """``memo[part]`` makes what is in neither generation."""

    def __init__(self, make: Callable[[str], Any]):
        super().__init__()
        self.make = make
        self.old: dict[str, Any] = {}

    def __missing__(self, part: str) -> Any:
        got = self.old.get(part)
        if got is None:
            got = self.make(part)
            if len(part) > MEMO_CHARS:
                return got
        if len(self) >= MEMO_ENTRIES // 2:
            self.old = dict(self)
            self.clear()
        self[part] = got
        return got


class Ids:
    """``bytes_of(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lower = self.library.normalizer is not None
        # The library's model alone: what it is given is one pre-token, its bytes as symbols.
        self.model = self.library.model
        self.memo = Memo(self.part)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        own = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_SYMBOL_OF))]
        return pack("<%dI" % len(own), *own)

    def bytes_of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not is_plain(text):
            return self.whole(text)
        parts = _WORD_LEVEL.findall(text.lower()) if self.lower else _BYTE_LEVEL.findall(text)
        return b"".join(map(self.memo.__getitem__, parts))


def ids(path: str) -> Ids:
    """One per Python worker, until it works for a stage with another vocabulary or without any."""
    return kept(path, lambda: Ids(path))
