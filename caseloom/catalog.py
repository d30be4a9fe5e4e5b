"""Definitions of entities, and the builder that collects them."""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from . import codecs
from .decorators import GatherNote, Notes, notes_of
from .descriptors import Name, Node, entity_name
from .errors import AlreadyDefinedEntityError, AttributeValidationError, IncompatibleEntityError, UndefinedEntityError
from .values import FixedValue, fixed

_ids = itertools.count()
VERSIONING_MODES = ("manual", "assist", "auto")


@dataclass(frozen=True)
class Function:
    """A function and what its decorators said; ``origin`` is the flow that it was merged from."""

    call: Callable
    args: tuple[tuple[str, Node], ...]
    output: Node
    notes: Notes
    origin: str | None = None

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(self.output.entities())

    @property
    def gathers(self) -> tuple[GatherNote, ...]:
        return self.notes.gathers

    def dependencies(self) -> list[str]:
        """Entities that it needs, gathered ones included."""
        into = {g.into for g in self.gathers}
        own = [e for _, node in self.args for e in node.entities() if e not in into] + list(self.notes.lifts)
        return list(dict.fromkeys([*own, *(n for g in self.gathers for n in (*g.over, *g.also))]))


@dataclass(frozen=True)
class Definition:
    """One entity: fixed (in a case group, attached to one, or unset) or derived."""

    name: str
    codec: codecs.Codec = codecs.DEFAULT
    doc: str | None = None
    persist: bool | None = None
    function: Function | None = None
    group: int | None = None
    attached: tuple[int, Keyed] | None = None  # a group of cases, and the entity's value for each case that has one
    default: bool = False

    @property
    def is_declared_only(self) -> bool:
        return self.function is None and self.group is None and self.attached is None


class Keyed:
    """Items by key in the order in which they came.  It only grows: versions share one list, and each knows how much of it is its own."""

    def __init__(self, items: Iterable[tuple[tuple[str, ...], Any]] = ()):
        self._items = list(items)
        self._at = {key: k for k, (key, _) in enumerate(self._items)}
        self._n = len(self._items)

    def __len__(self) -> int:
        return self._n

    def __iter__(self):
        return itertools.islice(self._items, self._n)

    def __contains__(self, key: tuple[str, ...]) -> bool:
        return self._at.get(key, self._n) < self._n

    def adding(self, key: tuple[str, ...], item: Any) -> Keyed:
        """With one item more; in constant time for the newest version."""
        if len(self._items) > self._n:  # a newer version has gone on from here
            out = Keyed(self)
        else:
            out = Keyed()
            out._items, out._at = self._items, self._at
        out._items.append((key, item))
        out._at[key] = len(out._items) - 1
        out._n = self._n + 1
        return out

    def last(self) -> tuple[str, ...]:
        """The key that came last."""
        return self._items[self._n - 1][0]


@dataclass(frozen=True)
class Cases:
    """Entities that vary together: their names in order, and one tuple of values for each case by its tokens."""

    names: tuple[str, ...]
    held: Keyed = field(default_factory=Keyed)

    @property
    def rows(self) -> list[tuple[FixedValue, ...]]:
        return [row for _, row in self.held]

    def values_of(self, name: str) -> Iterable[FixedValue]:
        k = self.names.index(name)
        return (row[k] for _, row in self.held)


@dataclass(frozen=True)
class State:
    """All definitions of a flow; never changed in place."""

    entities: dict[str, Definition]
    groups: dict[int, Cases]

    def get(self, name: str) -> Definition:
        if name not in self.entities:
            raise UndefinedEntityError(f"Entity {name!r} is not defined")
        return self.entities[name]

    def having(self, *definitions: Definition) -> State:
        return replace(self, entities={**self.entities, **{d.name: d for d in definitions}})

    def without(self, *names: str) -> State:
        return replace(self, entities={k: d for k, d in self.entities.items() if k not in names})

    def single(self, name: str) -> Any:
        """The value of a fixed entity with one case, else None."""
        d = self.entities.get(name)
        if d is None or d.group is None or len(self.groups[d.group].held) != 1:
            return None
        return next(iter(self.groups[d.group].values_of(name))).value

    def companions(self, name: str) -> set[str]:
        """Entities that are cleared, replaced or merged only together with this one."""
        d = self.get(name)
        if d.function is not None:
            return {x for x in d.function.outputs if x in self.entities and self.entities[x].function is d.function} | {name}
        return set(self.groups[d.group].names) if d.group is not None else {name}

    def cleared(self, names: Iterable[str]) -> State:
        """Unset; companions must be cleared together."""
        names = set(names)
        for n in names:
            if left := self.companions(n) - names:
                raise IncompatibleEntityError(f"{n!r} can't be cleared without {sorted(left)}")
        gone = {self.entities[n].group for n in names} - {None}
        new = [replace(self.entities[n], function=None, group=None, attached=None) for n in names]
        new += [replace(d, attached=None) for d in self.entities.values() if d.attached and d.attached[0] in gone and d.name not in names]
        return replace(self.having(*new), groups={k: g for k, g in self.groups.items() if k not in gone})

    def with_case(self, given: dict[str, Any]) -> tuple[State, int, tuple[str, ...]]:
        """One more case of the entities' joint group."""
        state, gid = self.with_cases(tuple(given), [tuple(given.values())])
        return state, gid, state.groups[gid].held.last()

    def with_cases(self, given: tuple[str, ...], values: Iterable[tuple]) -> tuple[State, int | None]:
        """More cases of the entities' joint group, in one step; without values nothing changes."""
        defs = [self.get(n) for n in given]
        for d in defs:
            if d.function is not None:
                raise IncompatibleEntityError(f"{d.name!r} is derived and has no cases of its own")
            if d.attached is not None:
                raise IncompatibleEntityError(f"{d.name!r} has values set for cases of other entities")
        gids = {d.group for d in defs}
        if len(gids) > 1:
            raise IncompatibleEntityError(f"{sorted(given)} do not belong to one group of cases")
        (gid,) = gids
        if gid is None:
            gid, group = next(_ids), Cases(tuple(sorted(given)))
        else:
            group = self.groups[gid]
            if set(group.names) != set(given):
                raise IncompatibleEntityError(f"cases of {list(group.names)} must name all of them, not {sorted(given)}")
        order, kinds = [given.index(n) for n in group.names], [self.get(n).codec for n in group.names]
        held = group.held
        for own in values:
            row = tuple(fixed(own[k], codec) for k, codec in zip(order, kinds))
            key = tuple(v.token for v in row)
            if key in held:
                raise IncompatibleEntityError(f"{dict(zip(given, own))} is a case already")
            held = held.adding(key, row)
        if held is group.held:
            return self, None
        groups = {**self.groups, gid: replace(group, held=held)}
        return replace(self.having(*(replace(d, group=gid) for d in defs)), groups=groups), gid


@dataclass
class FlowCase:
    """A case just added; ``then_set`` gives another entity a value for it."""

    builder: FlowBuilder
    group: int
    key: tuple[str, ...]

    def then_set(self, name: str, value: Any) -> FlowCase:
        state = self.builder._state
        d = state.get(name)
        if d.function is not None or d.group is not None or d.attached is not None and d.attached[0] != self.group:
            raise IncompatibleEntityError(f"{name!r} does not vary with these cases")
        values = d.attached[1] if d.attached else Keyed()
        if self.key in values:
            raise IncompatibleEntityError(f"{name!r} is set for this case already")
        self.builder._state = state.having(replace(d, attached=(self.group, values.adding(self.key, fixed(value, d.codec)))))
        return self


_MISSING = object()


def core_state(name: str) -> State:
    """The configuration: ordinary entities that any flow may set."""
    state = State({}, {})
    for key, value in {
        "core__flow_name": name,
        "core__memoize_by_default": True,
        "core__persist_by_default": True,
        "core__temp_memoize_if_uncached": True,
        "core__versioning_mode": "manual",
        "core__persistent_cache__global_dir": "caseloom-data",
    }.items():
        state, *_ = state.having(Definition(key, default=True)).with_case({key: value})
    for key in ("core__persistent_cache__flow_dir", "core__persistent_cache__cloud__url"):
        state = state.having(Definition(key, default=True))
    return state


class FlowBuilder:
    """Collects definitions; a call with a function, as a decorator, defines a derived entity."""

    def __init__(self, name: str, _state: State | None = None):
        self._state = core_state(name) if _state is None else _state

    # --- fixed entities

    def declare(self, name: str, protocol=None, doc: str | None = None, persist: bool | None = None) -> None:
        name = entity_name(name)
        if name in self._state.entities:
            raise AlreadyDefinedEntityError(f"Entity {name!r} is already defined")
        self._state = self._state.having(Definition(name, protocol or codecs.DEFAULT, doc, persist))

    def _values(self, value: Any, values: Any) -> list[Any]:
        if (value is _MISSING) == (values is _MISSING):
            raise ValueError("exactly one of value and values is needed")
        return [value] if values is _MISSING else list(values)

    def assign(self, name: str, value: Any = _MISSING, values: Any = _MISSING, protocol=None, doc: str | None = None, persist: bool | None = None) -> None:
        given, old = self._values(value, values), self._state
        try:
            self.declare(name, protocol, doc, persist)
            self._add(name, given)
        except Exception:
            self._state = old
            raise

    def set(self, name: str, value: Any = _MISSING, values: Any = _MISSING) -> None:
        given, old = self._values(value, values), self._state
        try:
            self._state = old.cleared([old.get(name).name])
            self._add(name, given)
        except Exception:
            self._state = old
            raise

    def _add(self, name: str, given: list[Any]) -> None:
        self._state, _ = self._state.with_cases((name,), ((v,) for v in given))

    def add_case(self, *names_and_values: Any) -> FlowCase:
        if not names_and_values or len(names_and_values) % 2:
            raise ValueError("names and values must alternate")
        names = names_and_values[::2]
        if len(set(names)) < len(names):
            raise ValueError("a name is given twice")
        self._state, gid, key = self._state.with_case(dict(zip(names, names_and_values[1::2])))
        return FlowCase(self, gid, key)

    def clear_cases(self, *names: str) -> None:
        self._state = self._state.cleared(names)

    def delete(self, *names: str) -> None:
        """Removes entities; those that vary together must go together, outputs of one function may go alone."""
        state = self._state
        for n in names:
            if state.get(n).function is None and (left := state.companions(n) - set(names)):
                raise IncompatibleEntityError(f"{n!r} can't be deleted without {sorted(left)}")
        fixed_ones = [n for n in names if state.get(n).function is None]
        self._state = state.cleared(fixed_ones).without(*names)

    # --- derived entities

    def __call__(self, function: Callable) -> Callable:
        """Defines the entities that the function gives; returns the function itself."""
        notes = notes_of(function)
        wanted = dict(notes.accepts)
        args = []
        for p in inspect.signature(function).parameters.values():
            if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD):
                raise TypeError(f"{function.__name__}: *args and **kwargs can't name entities")
            if p.name != notes.pyplot and not (notes.lifts and p.name == "cases"):
                args.append((p.name, wanted.pop(p.name, None) or Name(entity_name(p.name))))
        if wanted:
            raise ValueError(f"{function.__name__} has no arguments {sorted(wanted)}")
        output = notes.output or Name(entity_name(function.__name__))
        names = output.entities()
        if len(set(names)) < len(names):
            raise ValueError(f"{str(output)!r} names an entity twice")
        given = {a for a, _ in args}
        for g in notes.gathers:
            if g.into not in given:
                raise ValueError(f"{function.__name__} has no argument {g.into!r} for its gathered frame")
        if notes.kind in ("agg", "streamed") and len(notes.gathers) != 1:
            raise AttributeValidationError(f"{notes.kind} needs exactly one gather")
        if notes.kind == "cases" and notes.gathers:
            raise AttributeValidationError("cases are made of DataFrames and values, not of gathered ones")
        if notes.docs is not None and len(notes.docs) != len(names):
            raise ValueError(f"{len(names)} outputs need as many docs, not {len(notes.docs)}")
        if notes.changes_per_run and notes.memoize is False and notes.persist is False:
            raise AttributeValidationError("what changes per run must be kept for the run")
        made = Function(function, tuple(args), output, notes)
        state = self._state
        for n in names:  # an old definition gives way, with its companions still whole
            if n in state.entities:
                if left := state.companions(n) - set(names):
                    raise IncompatibleEntityError(f"{n!r} can't be redefined without {sorted(left)}")
        old = {n: state.entities.get(n) for n in names}
        state = state.cleared([n for n in names if n in state.entities])
        texts = notes.docs or ((inspect.getdoc(function),) * len(names))
        self._state = state.having(
            *(
                Definition(
                    n,
                    notes.codec or (old[n].codec if old[n] and old[n].is_declared_only else codecs.DEFAULT),
                    texts[k] or (old[n].doc if old[n] else None),
                    notes.persist,
                    made,
                )
                for k, n in enumerate(names)
            )
        )
        return function

    # --- whole flows

    def merge(self, flow, keep: str = "error", allow_name_match: bool = False) -> None:
        """Takes over another flow's definitions.  ``keep``: which side stays where both define a name."""
        if keep not in ("error", "old", "self", "new", "arg"):
            raise ValueError("keep is 'error', 'old', 'self', 'new' or 'arg'")
        mine, theirs = self._state, flow._state
        name = theirs.single("core__flow_name")
        if not allow_name_match and name is not None and name == mine.single("core__flow_name"):
            raise ValueError(f"both flows are named {name!r}; use allow_name_match=True if this is meant")
        takes_new: dict[str, bool] = {}
        for n in sorted(mine.entities.keys() | theirs.entities.keys()):
            old, new = mine.entities.get(n), theirs.entities.get(n)
            if old is None or new is None:
                takes_new[n] = old is None
            elif n == "core__flow_name" or new.default:
                takes_new[n] = False
            elif old.default:
                takes_new[n] = True
            elif old.codec == new.codec and new.is_declared_only:
                takes_new[n] = False
            elif old.codec == new.codec and old.is_declared_only:
                takes_new[n] = True
            elif keep == "error":
                raise ValueError(f"{n!r} is defined on both sides; say with keep which one stays")
            else:
                takes_new[n] = keep in ("new", "arg")
        for state, side in ((mine, False), (theirs, True)):
            for n in state.entities:
                both = {takes_new[c] == side for c in state.companions(n)}
                if len(both) > 1:
                    raise IncompatibleEntityError(f"{sorted(state.companions(n))} vary together and can only stay or go as a whole")
        groups: dict[int, Cases] = {}
        entities: dict[str, Definition] = {}
        stamped: dict[int, Function] = {}
        for n, new in takes_new.items():
            source = theirs if new else mine
            d = source.entities[n]
            if new and d.function is not None:
                f = stamped.setdefault(id(d.function), replace(d.function, origin=d.function.origin or name))
                d = replace(d, function=f)
            for gid in {d.group, d.attached[0] if d.attached else None} - {None}:
                groups[gid] = source.groups[gid]
            entities[n] = d
        self._state = State(entities, groups)

    def build(self):
        from .flow import Flow

        return Flow(self._state)

