"""Fingerprints of functions' code."""

from __future__ import annotations

import hashlib
import inspect
import types
from collections.abc import Callable


def code_hash(function: Callable) -> str:
    """Bytecode, constants, names, defaults and closure, and those of the functions it refers to in its own package.

    Library functions count by their names.
    """
    h = hashlib.sha256()
    _add(h, function, set(), function.__module__.split(".")[0] if function.__module__ else "")
    return h.hexdigest()


def _add(h, value, seen: set[int], package: str) -> None:
    def put(kind: str, text: str) -> None:
        h.update(f"{kind}:{len(text)}:{text};".encode("utf-8", "surrogatepass"))

    if isinstance(value, types.FunctionType):
        if id(value) in seen:
            return put("again", value.__qualname__)
        seen.add(id(value))
        if (value.__module__ or "").split(".")[0] != package:
            return put("library", f"{value.__module__}.{value.__qualname__}")
        put("function", "")
        _add(h, value.__code__, seen, package)
        _add(h, [value.__defaults__, value.__kwdefaults__], seen, package)
        for name, cell in sorted(inspect.getclosurevars(value).nonlocals.items()):
            put("closure", name)
            _add(h, cell, seen, package)
        for name, used in sorted(inspect.getclosurevars(value).globals.items()):
            put("global", name)
            _add(h, used, seen, package)
    elif isinstance(value, types.CodeType):
        put("code", value.co_code.hex())
        put("names", " ".join((*value.co_names, *value.co_varnames)))
        for c in value.co_consts:
            _add(h, c, seen, package)
    elif isinstance(value, (list, tuple)):
        put("list", str(len(value)))
        for v in value:
            _add(h, v, seen, package)
    elif isinstance(value, (set, frozenset)):
        put("set", " ".join(sorted(map(repr, value))))
    elif isinstance(value, dict):
        put("dict", str(len(value)))
        for k in sorted(value, key=repr):
            _add(h, [k, value[k]], seen, package)
    elif isinstance(value, (str, bytes, int, float, complex, bool, type(None), type(...))):
        put(type(value).__name__, repr(value))
    elif isinstance(value, type):
        put("class", f"{value.__module__}.{value.__qualname__}")
        if value.__module__.split(".")[0] == package and id(value) not in seen:
            seen.add(id(value))
            for k, v in sorted(vars(value).items()):
                if not k.startswith("__") or k in ("__init__", "__call__"):
                    put("member", k)
                    _add(h, v, seen, package)
    elif isinstance(value, types.ModuleType):
        put("module", value.__name__)
    else:
        put("other", f"{type(value).__module__}.{type(value).__qualname__}")
