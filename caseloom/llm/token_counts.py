"""Token counts: heap-and-linked-list byte-pair merging, without emitting ids.

Each pre-token starts as a linked list of byte symbols with a heap of adjacent
pairs by (rank, place).  The lowest pair is popped and merged until none is
left; the count is the initial symbols less the merges.  Special tokens of the
vocabulary that stand in a text count one each, as the library has it.

Nulls and edge cases: a null text is empty and counts 0; texts of any length
are taken whole; repeated ids are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from ._common import map_rows
from .tokens import Memo, byte_level_parts, byte_symbols, is_plain

#: Unicode white space, spelled out: libraries differ in what their \s takes in.
_WS = "\t-\r \x85\xa0  -     　"


class MergeCounter:
    """Numbers of tokens of texts; a pre-token that the memo lacks is merged."""

    def __init__(self, path: str):
        import regex

        self.memo = Memo(self.merged)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.symbol = byte_symbols()
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.at_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.parts = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
        )

    def merged(self, part: str) -> int:
        rank = self.rank
        symbols: list[str | None] = [self.symbol[b] for b in part.encode()]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank.get((symbols[k], symbols[k + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            r, k = heappop(heap)
            if symbols[k] is None or (j := after[k]) >= n or rank.get((symbols[k], symbols[j])) != r:
                continue  # one of the two has been merged since
            symbols[k], symbols[j] = symbols[k] + symbols[j], None
            merges += 1
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                if (s := rank.get((symbols[k], symbols[m]))) is not None:
                    heappush(heap, (s, k))
            if (p := before[k]) >= 0 and (s := rank.get((symbols[p], symbols[k]))) is not None:
                heappush(heap, (s, p))
        return n - merges

    def count(self, text: str | None) -> int:
        text = text or ""
        if is_plain(text):
            return sum(map(self.memo.__getitem__, byte_level_parts(text)))
        pieces = self.at_special.split(text)
        return len(pieces) - 1 + sum(sum(map(self.memo.__getitem__, self.parts.findall(p))) for p in pieces)


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    """One per Python worker and vocabulary."""
    return MergeCounter(path)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""

    def row(key, text):
        n = counter(tokenizer_path).count(text)
        return [(key, len((text or "").encode()), n, n > limit)]

    return map_rows(docs, [id_col, text_col], row, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
