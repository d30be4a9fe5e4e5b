"""Decorators of functions that define entities.  They only take notes; ``FlowBuilder`` reads them."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from .descriptors import Group, Name, Node, entity_name, parse
from .errors import AttributeValidationError

_KEY = "__caseloom_notes__"


@dataclass(frozen=True)
class GatherNote:
    over: tuple[str, ...]
    also: tuple[str, ...]
    into: str


@dataclass(frozen=True)
class Notes:
    """What the decorators of one function said."""

    output: Node | None = None
    accepts: tuple[tuple[str, Node], ...] = ()
    gathers: tuple[GatherNote, ...] = ()
    docs: tuple[str, ...] | None = None
    codec: Any = None
    persist: bool | None = None
    memoize: bool | None = None
    version: tuple[str, str] | None = None
    quiet_versions: bool = False
    ignore_code: bool = False
    changes_per_run: bool | None = None
    kind: str | None = None
    returns_type: str | None = None
    pyplot: str | None = None
    resources: tuple[tuple[str, Any], ...] | None = None
    lifts: tuple[str, ...] = ()
    merges: tuple[tuple[str, ...], tuple[tuple[str, str], ...]] | None = None


def notes_of(function: Callable) -> Notes:
    return getattr(function, _KEY, Notes())


def _note(function: Callable, key: str, value: Any, repeat: str = "error", also: dict[str, Any] | None = None) -> Callable:
    """Notes ``key``.  A second note is an error, unless ``repeat`` is "outer": then the uppermost one stays, with a warning."""
    old = notes_of(function)
    if getattr(old, key) is not None and getattr(old, key) != ():
        if repeat == "error":
            raise (ValueError if key in ("version", "changes_per_run", "resources") else AttributeValidationError)(
                f"{function.__name__} has more than one {key} decorator"
            )
        warnings.warn(f"{function.__name__} has more than one {key} decorator; the uppermost one holds", stacklevel=3)
    setattr(function, _KEY, replace(old, **{key: value}, **(also or {})))
    return function


def _names(given: str | Sequence[str] | None) -> tuple[str, ...]:
    found = () if given is None else (given,) if isinstance(given, str) else tuple(given)
    return tuple(map(entity_name, found))


def output(name: str):
    """The entity's name, if it is not the function's."""
    return lambda f: _note(f, "output", Name(entity_name(name)))


def outputs(*names: str):
    """The function gives a tuple; each part is an entity."""
    return lambda f: _note(f, "output", Group(tuple(Name(entity_name(n)) for n in names)))


def returns(descriptor: str):
    """The function gives what the descriptor says, tuples within tuples included."""
    return lambda f: _note(f, "output", parse(descriptor))


def accepts(**descriptors: str):
    """Arguments that take another entity than their name says, or a tuple of entities."""
    return lambda f: _note(f, "accepts", tuple((k, parse(v)) for k, v in descriptors.items()))


def gather(over, also=None, into: str = "gather_df"):
    """The argument ``into`` is a frame of all cases of ``over``, and ``also``, one frame for each case of the rest of ``also``."""

    def decorate(f):
        old = notes_of(f)
        setattr(f, _KEY, replace(old, gathers=(GatherNote(_names(over), _names(also), into), *old.gathers)))
        return f

    return decorate


def docs(*texts: str):
    return lambda f: _note(f, "docs", texts)


def persist(enabled: bool):
    """Whether results go to the store."""
    return lambda f: _note(f, "persist", bool(enabled))


def memoize(enabled: bool):
    """Whether results that are not stored stay in executor memory for the life of the flow."""
    return lambda f: _note(f, "memoize", bool(enabled))


def immediate(f):
    """For entities that the configuration needs: never stored."""
    return persist(False)(f)


def version(major=None, minor=None, ignore_bytecode: bool = False, suppress_bytecode_warnings: bool = False):
    """The code's version: a new major one computes anew, a new minor one says that results stay the same."""
    for v in (major, minor):
        if not isinstance(v, (int, str, type(None))):
            raise ValueError(f"a version is an integer or a string, not {v!r}")
    pair = tuple("0" if v is None else str(v) for v in (major, minor))
    return lambda f: _note(
        f, "version", pair, also={"quiet_versions": suppress_bytecode_warnings or ignore_bytecode, "ignore_code": ignore_bytecode}
    )


def version_no_warnings(f=None, **kwargs):
    """As ``version``, without errors on changed code."""
    if callable(f):
        return version(suppress_bytecode_warnings=True)(f)
    return version(f, suppress_bytecode_warnings=True, **kwargs)


def changes_per_run(f):
    """The function may give another value each time; each flow object computes it once."""
    return _note(f, "changes_per_run", True)


def pyplot(name: str = "pyplot"):
    """The argument ``name`` is matplotlib's pyplot; the entity is the figure drawn."""
    return lambda f: _note(f, "pyplot", name)


def run_with(**resources):
    """What the function's Spark jobs need.

    ``cpus`` and ``gpus`` (for each task), ``memory``, ``overhead`` and ``cores`` (of an executor, as ``"4g"``, ``"1g"``, 4)
    make the profile of the stage that calls the function, where the cluster manager has stage-level scheduling; without
    dynamic allocation Spark takes the tasks' part of it alone, of GPUs only where executors have as many, and a local master none.  Everything is put on the jobs as
    local properties ``caseloom.<name>`` too; ``pool`` is their scheduler pool.
    """
    return lambda f: _note(f, "resources", tuple(sorted(resources.items())))


def expr(f):
    """The function takes Columns and gives a Column: all cases are one projection."""
    return _note(f, "kind", "expr")


def agg(f):
    """Under ``gather``: the function takes the gathered Columns by name and gives an aggregate Column."""
    return _note(f, "kind", "agg")


def frame(f):
    """The function gives a Spark DataFrame (and may take some)."""
    return _note(f, "kind", "frame")


def lifted(*names: str):
    """All cases in one plan: the argument ``cases`` is a DataFrame of ``case_id`` and the named entities.

    The function joins it with its other arguments' DataFrames and gives a
    DataFrame with ``case_id``; the rows of each case are stored as its value.
    """
    return lambda f: _note(f, "kind", "lifted", also={"lifts": tuple(map(entity_name, names))})


def cases(f):
    """The function gives a Spark DataFrame: each of its different rows is a case of the outputs, which vary together.

    The cases stay a DataFrame, so there may be as many as there are users in a table.
    """
    return _note(f, "kind", "cases")


def streamed(f):
    """Under ``gather``: the function takes the group as an iterator of pandas frames of some rows each, and no group is held whole."""
    return _note(f, "kind", "streamed")


#: How states of a column are merged.
MERGES = ("sum", "min", "max", "and", "or", "hll")


def rollup(by: str | Sequence[str] = (), **merges: str):
    """The function gives a DataFrame of states of a ``FileSource``: one row for each different ``by``, and columns that can be merged.

    ``merges`` says how: sum, min, max, and, or, hll (sketches of ``hll_sketch_agg``).  States are kept with the
    files that they were made from; when files are added, only those are read.
    """
    if wrong := {k: v for k, v in merges.items() if v not in MERGES}:
        raise AttributeValidationError(f"{wrong}: states are merged by one of {MERGES}")
    return lambda f: _note(f, "kind", "rollup", also={"merges": ((by,) if isinstance(by, str) else tuple(by), tuple(sorted(merges.items())))})


def typed(spark_type: str):
    """The Spark type of what the function gives, so that ``expr`` and ``agg`` functions can use it."""
    return lambda f: _note(f, "returns_type", spark_type)
