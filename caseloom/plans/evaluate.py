"""Evaluation of requests: entity relations as lazy DataFrames over stored results.

An entity's relation is its dependencies' natural join with the function on
top.  A stored function's rows are looked up in the store by their provenance,
with an anti join for what is not there; only those rows call the function, and
what follows reads the stored result.  Because a stored dependency counts by its
value's hash, a recomputed but equal value leaves its dependents' provenance as
it was.
"""

from __future__ import annotations

import logging
import re
import weakref
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import _parse_datatype_string

from ..catalog import Function, State
from ..codecs import DEFAULT, content_hash
from ..descriptors import Name, Node
from ..errors import CodeVersioningError, EntityComputationError, EntitySerializationError, EntityValueError, UnsetEntityError
from ..functions.fingerprint import fingerprint, row_hash, value_hash
from ..operators import map as maps
from ..operators.gather import gather_agg, gather_frame, gather_keys_of_stream
from ..operators.join import join_all
from ..operators.relation import Relation, col_name, missing
from ..operators.source import fixed_relation
from ..values import FileSource, spark_type
from .code import code_hash
from .resources import stage_profile
from .states import States
from .store import CASE, Store, provenance

log = logging.getLogger("caseloom")
#: More cases of a frame function than this are worth a warning: each is one plan.
MANY_CASES = 1000
#: Plans of different cases that Spark is given at one time.
AT_ONCE = 8


@dataclass
class Settings:
    memoize: bool
    persist: bool
    mode: str
    store: Store
    run_id: str
    brief: bool = True  # keep for one request what is neither stored nor memoized


@dataclass
class Evaluator:
    """Holds the relations made for one flow, and what it keeps in executor memory."""

    spark: SparkSession
    state: State
    settings: Settings
    relations: dict[str, Relation] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    sources: dict[str, FileSource] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)
    brief: list[tuple[str, DataFrame]] = field(default_factory=list)

    # --- key spaces and checks, without touching data

    def keys_of(self, name: str, path: tuple[str, ...] = ()) -> frozenset[str]:
        """The fixed entities that an entity varies with; raises for undefined or circular dependencies."""
        if name in path:
            raise ValueError(f"circular dependency: {' -> '.join((*path, name))}")
        d = self.state.get(name)
        if d.function is None:
            gid = d.group if d.group is not None else d.attached[0] if d.attached else None
            return frozenset(self.state.groups[gid].names) if gid is not None else frozenset({name})
        f, path = d.function, (*path, name)
        gathered = set()
        keys: set[str] = set(f.outputs) if f.notes.kind == "cases" else set()
        for g in f.gathers:
            over = frozenset().union(*(self.keys_of(n, path) for n in g.over))
            also = frozenset().union(*(self.keys_of(n, path) for n in g.also))
            keys |= also - over
            gathered.add(g.into)
        for e in (*(e for _, node in f.args for e in node.entities()), *f.notes.lifts):
            if e not in gathered:
                keys |= self.keys_of(e, path)
        return frozenset(keys)

    # --- relations

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            d = self.state.get(name)
            if d.function is None:
                self.relations[name] = self._fixed(name)
            else:
                whole = self._derived(d.function)
                for n in d.function.outputs:
                    if n in self.state.entities and self.state.entities[n].function is d.function:
                        self.relations[n] = whole.only(n)
        return self.relations[name]

    def of_node(self, node: Node) -> Relation:
        """The natural join of a descriptor's entities."""
        return join_all(self.spark, [self.relation(n) for n in dict.fromkeys(node.entities())])

    def _fixed(self, name: str) -> Relation:
        d = self.state.get(name)
        if d.group is not None:
            g = self.state.groups[d.group]
            k = g.names.index(name)
            names, rows = g.names, [(key, row[k]) for key, row in g.held]
        elif d.attached is not None:
            names, rows = self.state.groups[d.attached[0]].names, list(d.attached[1])
        else:
            names, rows = (name,), [((None,), None)]
        for _, v in rows:
            if v is not None and v.codec == "frame":
                self.frames[f"fixed:{name}:{v.token}"] = v.value
                if v.source is not None:
                    self.sources[f"fixed:{name}:{v.token}"] = v.source
        codec = self.state.entities[name].codec if name in self.state.entities else DEFAULT
        return fixed_relation(self.spark, name, names, rows, self.settings.store.cases if self.settings.store.roots else None, codec)

    def _derived(self, f: Function) -> Relation:
        into = {g.into: (*g.over, *(n for n in g.also if n not in g.over)) for g in f.gathers}
        if f.notes.kind == "agg":
            return self._aggregate(f)
        if f.notes.kind == "cases":
            return self._cases(f)
        parts = []
        for g in f.gathers:
            names = into[g.into]
            rows = join_all(self.spark, [self.relation(n) for n in names])
            primary = frozenset().union(*(self.relation(n).keys for n in g.over))
            parts.append((gather_keys_of_stream if f.notes.kind == "streamed" else gather_frame)(rows, primary, names, g.into))
        own = dict.fromkeys([*(e for _, node in f.args for e in node.entities() if e not in into), *f.notes.lifts])
        parts += [self.relation(n) for n in own]
        joined = join_all(self.spark, parts)
        hashes = [F.concat_ws("=", F.lit(n), F.col(col_name("h", n))) for n in sorted(joined.entities)]
        there = ~missing(joined.keys)
        keyed = joined.df.withColumn("p", F.when(there, provenance([F.lit(self._identity(f)), *hashes])))
        frames_in = any(
            joined.df.schema[col_name("v", n)].dataType == T.StringType() and self._has_frames(n) for n in own
        ) or any(self._has_frames(n) for names in into.values() for n in names)
        keys = [col_name("k", k) for k in sorted(joined.keys)]
        if f.notes.kind == "lifted":
            compute = lambda rows: self._lifted(f, rows)
        elif f.notes.kind == "streamed":
            (g,) = f.gathers
            compute = lambda todo: self._streamed(f, g.into, into[g.into], rows, primary, todo)
        elif f.notes.kind in ("frame", "rollup") or frames_in:
            compute = lambda rows: self._on_driver(f, into, rows)
        elif f.notes.kind == "expr":
            compute = lambda rows: self._expression(f, rows)
        else:
            compute = lambda rows: self._in_tasks(f, into, rows)
        if self._persisted(f):
            out = self._stored(f, keyed, keys, compute)
        else:
            done = self._unpacked(f, compute(keyed.where(there)), keys)
            for n in f.outputs:
                done = done.withColumn(col_name("h", n), F.concat_ws(":", "p", F.lit(n)))
            gaps = keyed.where(~there).select(*keys, "p")
            for n in f.outputs:
                for c in (col_name("h", n), col_name("v", n), col_name("c", n)):
                    gaps = gaps.withColumn(c, F.lit(None).cast(done.schema[c].dataType))
            out = done.unionByName(gaps)
            if self._memoized(f):
                self.kept.append(out := out.persist())
            elif self.settings.brief:
                out = out.persist()
                self.brief += [(n, out) for n in f.outputs]
        columns = [c for n in f.outputs for c in (col_name("h", n), col_name("v", n), col_name("c", n))]
        return Relation(out.select(*keys, *columns), joined.keys, f.outputs)

    def _aggregate(self, f: Function) -> Relation:
        (g,) = f.gathers
        names = (*g.over, *(n for n in g.also if n not in g.over))
        rows = join_all(self.spark, [self.relation(n) for n in names])
        primary = frozenset().union(*(self.relation(n).keys for n in g.over))
        (out,) = f.outputs
        codec = self._codecs(f)[out]
        made = lambda columns: maps.typed_result(f.call(**{g.into: columns}), codec.spark_type or f.notes.returns_type)
        return gather_agg(rows, primary, names, out, made, codec.name if codec.spark_type else None)

    def _has_frames(self, name: str) -> bool:
        d = self.state.get(name)
        if d.function is None:
            values = self.state.groups[d.group].values_of(name) if d.group is not None else ()
            return any(v.codec == "frame" for v in values)
        return d.function.notes.kind in FRAME_KINDS or name in self._frame_results

    @property
    def _frame_results(self) -> set[str]:
        return self.__dict__.setdefault("_frame_names", set())

    # --- identity, and the store

    def _persisted(self, f: Function) -> bool:
        if f.notes.kind == "agg":
            return False
        flags = {self.state.entities[n].persist for n in f.outputs if n in self.state.entities} - {None}
        return flags.pop() if flags else self.settings.persist

    def _memoized(self, f: Function) -> bool:
        return True if f.notes.changes_per_run else self.settings.memoize if f.notes.memoize is None else f.notes.memoize

    def _identity(self, f: Function) -> str:
        major, _ = f.notes.version or ("0", "0")
        parts = [f.origin or "", str(f.output), major]
        if self.settings.mode == "auto" and not f.notes.ignore_code:
            parts.append(code_hash(f.call))
        if f.notes.changes_per_run:
            parts.append(self.settings.run_id)
        # What Spark holds of a value depends on how its codec was declared.
        parts += [f"{n}:{c.name}{sorted(vars(c).items())}" for n, c in self._codecs(f).items() if c.spark_type]
        return "/".join(parts)

    def _table(self, f: Function) -> str:
        return "-".join(f.outputs) or "unit"

    def _stored(self, f: Function, keyed: DataFrame, keys: list[str], compute) -> DataFrame:
        store, table, there = self.settings.store, self._table(f), F.col("p").isNotNull()
        wanted = keyed.where(there)
        code, minor = code_hash(f.call), (f.notes.version or ("0", "0"))[1]
        store_schema = self._schema(f, compute(wanted).schema if f.notes.kind == "expr" else None)
        store.mirror(table)
        cold = store.is_empty(table)
        have = store.read(table, store_schema)
        if self.settings.mode == "assist" and not f.notes.quiet_versions and not cold:
            changed = wanted.select("p").join(have, "p").where((F.col("minor") == minor) & (F.col("code") != code))
            if not changed.isEmpty():
                raise CodeVersioningError(
                    f"the code of {self._table(f)!r} changed but its version did not; give it a new version", str(f.output)
                )
        # Hits are found by keys and hashes alone; values are read only for rows that call the function.
        rows = wanted
        if not cold:
            todo = wanted.select("p").join(have.select("p"), "p", "left_anti")
            rows = None if todo.isEmpty() else wanted.join(have.select("p"), "p", "left_anti")
        log.info("%s %s", "loading" if rows is None else "computing", table)
        if rows is not None:
            try:
                with self._resources(f):
                    made = compute(rows.dropDuplicates(["p"])).select("p", *(f"o{k}" for k in range(len(f.outputs))))
                    made = made.withColumn("minor", F.lit(minor)).withColumn("code", F.lit(code))
                    store.append(table, made.select(*[x.name for x in store_schema]), len(f.outputs))
            except Exception as e:
                raise self._as_own(e) from e
            have = store.read(table, store_schema)
        unpacked = have.select("p", *(c for k, n in enumerate(f.outputs) for c in self._parts(k, n)))
        return keyed.select(*keys, "p").join(unpacked, "p", "left")

    @contextmanager
    def _resources(self, f: Function) -> Iterator[None]:
        """The jobs inside carry what ``run_with`` said as local properties; ``pool`` names their scheduler pool."""
        context = self.spark.sparkContext
        own = {"spark.scheduler.pool" if k == "pool" else f"caseloom.{k}": str(v) for k, v in f.notes.resources or ()}
        before = {k: context.getLocalProperty(k) for k in own}
        try:
            for k, v in own.items():
                context.setLocalProperty(k, v)
            yield
        finally:
            for k, v in before.items():
                context.setLocalProperty(k, v)

    def _parts(self, k: int, name: str) -> list:
        return [F.col(f"o{k}.h").alias(col_name("h", name)), F.col(f"o{k}.v").alias(col_name("v", name)), F.col(f"o{k}.c").alias(col_name("c", name))]

    def _unpacked(self, f: Function, computed: DataFrame, keys: list[str] = []) -> DataFrame:
        return computed.select(*keys, "p", *(c for k, n in enumerate(f.outputs) for c in self._parts(k, n)))

    def _schema(self, f: Function, computed: T.StructType | None) -> T.StructType:
        codecs = self._codecs(f)
        kind = lambda k: maps.result_type(codecs[f.outputs[k]]) if computed is None else computed[f"o{k}"].dataType
        if f.notes.kind in FRAME_KINDS or self._frame_results & set(f.outputs):
            kind = lambda k: FRAME_RESULT
        return T.StructType(
            [
                *(T.StructField(f"o{k}", kind(k)) for k in range(len(f.outputs))),
                T.StructField("minor", T.StringType()),
                T.StructField("code", T.StringType()),
                T.StructField("p", T.StringType()),
            ]
        )

    @staticmethod
    def _as_own(e: Exception) -> Exception:
        """The library's error for what a task raised."""
        if isinstance(e, (EntityComputationError, EntityValueError)):
            return e
        for name, kind in {
            "RuntimeError: EntityComputationError": EntityComputationError,
            "EntityValueError": EntityValueError,
            "EntitySerializationError": EntitySerializationError,
        }.items():
            if found := re.findall(rf"{name}: (.*)", str(e)):
                return kind(found[-1])
        return e

    # --- the three ways to compute

    def _codecs(self, f: Function) -> dict:
        return {n: self.state.entities[n].codec if n in self.state.entities else DEFAULT for n in f.outputs}

    @staticmethod
    def _function(f: Function):
        """What is called: a plotting function gives its figure."""
        if f.notes.pyplot:
            from ..sources.figures import drawn

            return drawn(f.call, f.notes.pyplot)
        return f.call

    def _in_tasks(self, f: Function, into: dict, rows: DataFrame) -> DataFrame:
        given = (self._function(f), list(f.args), into, f.output, self._codecs(f), str(f.output))
        if profile := stage_profile(self.spark, dict(f.notes.resources or ())):
            return maps.profiled_map(rows, *given, profile)
        got = maps.python_map(*given)
        return rows.withColumn("got", got).select("*", *(F.col(f"got.o{k}").alias(f"o{k}") for k in range(len(f.outputs))))

    def _streamed(self, f: Function, into: str, names: tuple[str, ...], rows: Relation, primary: frozenset[str], todo: DataFrame) -> DataFrame:
        """The members of the groups that are asked for, dealt by group."""
        delta = [col_name("k", k) for k in sorted(rows.keys - primary)]
        values = [c for n in maps.value_names(f.args, (into,)) for c in (col_name("v", n), col_name("c", n))]
        own = [c for n in names for c in (col_name("v", n), col_name("c", n))]
        members = rows.df.select(*(F.col(c).alias(f"m_{c}") for c in delta), *(F.col(c).alias(f"m_{c}") for c in own), (~missing(primary)).alias("there"))
        wanted = todo.select(*delta, "p", *values)
        joined = members.join(wanted, [F.col(f"m_{c}").eqNullSafe(F.col(c)) for c in delta]) if delta else members.crossJoin(wanted)
        joined = joined.select("p", "there", *values, *(F.col(f"m_{c}").alias(c) for c in own if c not in values))
        made = maps.streamed_map(joined, self._function(f), list(f.args), into, names, f.output, self._codecs(f), str(f.output))
        return todo.join(made, "p")

    def _cases(self, f: Function) -> Relation:
        """Cases that a function made of data.  Its DataFrame is stored as others are, and stays one: no case is listed on the driver."""
        inner = replace(f, output=Name("-".join(("cases", *f.outputs))), notes=replace(f.notes, kind="frame"))
        made = self._derived(inner)
        (name,) = inner.outputs
        found = made.df.where(~missing(made.keys)).collect()  # one for each case of the function's arguments
        keys = [col_name("k", k) for k in sorted(made.keys)]
        if not found:
            raise UnsetEntityError(f"cases of {', '.join(f.outputs)} need a value of each argument")
        rows = self.together([r[col_name("v", name)] for r in found], [{k: r[k] for k in keys} for r in found], keys)
        if wrong := [n for n in f.outputs if n not in rows.columns or rows.schema[n].dataType.typeName() == "binary"]:
            raise EntityComputationError(f"error while computing {f.output}: the cases have no columns {wrong}, or binary ones")
        rows = rows.select(*keys, *f.outputs).distinct()
        own = [
            c
            for n in f.outputs
            for c in (value_hash(F.col(n)).alias(col_name("k", n)), value_hash(F.col(n)).alias(col_name("h", n)), F.col(n).alias(col_name("v", n)), F.lit(None).cast("string").alias(col_name("c", n)))
        ]
        return Relation(rows.select(*keys, *own), made.keys | set(f.outputs), f.outputs)

    def _expression(self, f: Function, rows: DataFrame) -> DataFrame:
        value = maps.expression_map(f.call, list(f.args))
        values = [value] if isinstance(f.output, Name) else [v for _, v in maps.leaves(f.output, value)]
        codecs = self._codecs(f)
        for k, v in enumerate(values):
            codec = codecs[f.outputs[k]]
            v = maps.typed_result(v, codec.spark_type or f.notes.returns_type)
            rows = rows.withColumn(f"o{k}", F.struct(F.lit(codec.name if codec.spark_type else None).cast("string").alias("c"), v.alias("v"), value_hash(v).alias("h")))
        return rows

    def frame_at(self, pointer: str) -> DataFrame:
        """Behind ``#`` stands the case whose rows are meant of a folder that holds those of many."""
        if pointer in self.frames:
            return self.frames[pointer]
        folder, _, case = pointer.partition("#")
        df = self.spark.read.parquet(self.settings.store.locate(folder))
        return df.where(F.col(CASE) == case).drop(CASE) if case else df

    def _value(self, codec: str | None, value):
        return self.frame_at(value) if codec == "frame" else maps.decode(codec, value)

    def _gathered(self, items: list, names: tuple[str, ...]):
        """The frame of gathered cases: rows of gathered DataFrames, with the scalars of their case as columns.

        Several gathered entities that are DataFrames are kept apart, in a dict by name.  Where
        no case is there, the frame has the scalars' columns and no rows.
        """
        frames = [n for n in names if self._has_frames(n)]
        if not frames:
            return maps.gathered_frame(items, names)
        scalars = [n for n in names if n not in frames]
        rows = [{n: maps.decode(r[col_name("c", n)], r[col_name("v", n)]) for n in scalars} for r in items]
        made = {n: self.together([r[col_name("v", n)] for r in items], rows, scalars) for n in frames}
        return made if len(made) > 1 else made[frames[0]]

    def beside(self, cases: DataFrame, folders: list[str], scalars: list[str]) -> DataFrame:
        """The rows of the DataFrames that ``pointer`` names in a few folders of many cases each, with the scalars of their case; a join for each folder."""
        parts = []
        for folder in folders:
            own = cases.where(F.substring_index("pointer", "#", 1) == folder).withColumn(CASE, F.substring_index("pointer", "#", -1)).drop("pointer")
            rows = self.spark.read.parquet(self.settings.store.locate(folder))
            parts.append(rows.drop(*scalars).join(own, CASE).drop(CASE))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def together(self, pointers: list[str], rows: list[dict[str, Any]], scalars: list[str]) -> DataFrame:
        """The rows of DataFrames, each with the scalars of its case as columns; what one write stored is one scan."""
        kinds = {n: spark_type([r[n] for r in rows if r[n] is not None]) for n in scalars}
        schema = T.StructType([T.StructField(n, _parse_datatype_string(kinds[n] or "string")) for n in scalars])
        own = [tuple(r[n] if kinds[n] or r[n] is None else str(r[n]) for n in scalars) for r in rows]
        groups: dict[tuple[str, bool], list[int]] = {}
        for k, pointer in enumerate(pointers):
            folder, _, case = pointer.partition("#")
            base = pointer if pointer in self.frames else folder if case else folder.rpartition(f"/{CASE}=")[0]
            groups.setdefault((base or pointer, bool(case)), []).append(k)
        parts = []
        for (base, shared), at in groups.items():
            if len(at) == 1 and not shared:
                df = self.frame_at(pointers[at[0]]).drop(*scalars)
                literals = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(own[at[0]], schema)]
                parts.append(df.select("*", *literals))
                continue
            if shared:
                read = self.spark.read.parquet(self.settings.store.locate(base))
            else:
                paths = [self.settings.store.locate(pointers[k]) for k in at]
                leaf = self.spark.read.parquet(paths[0]).schema
                read = self.spark.read.schema(T.StructType([*leaf, T.StructField(CASE, T.StringType())]))
                read = read.option("basePath", paths[0].rpartition(f"/{CASE}=")[0]).parquet(*paths)
            case_of = lambda pointer: pointer.rpartition("#" if shared else f"/{CASE}=")[2]  # noqa: B023, E731
            cases = [(case_of(pointers[k]), *own[k]) for k in at]
            # Case tables are parameter values; Spark broadcasts them by its own size check.
            table = self.spark.createDataFrame(cases, T.StructType([T.StructField(CASE, T.StringType()), *schema]))
            parts.append(read.drop(*scalars).join(table, CASE).drop(CASE))
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], schema)

    def _lifted(self, f: Function, rows: DataFrame) -> DataFrame:
        """One plan and one write for all cases that the store lacks."""
        shared: dict[str, str] = {}
        names = [e for _, node in f.args for e in node.entities()]
        for row in rows.select(*(c for n in names for c in (col_name("c", n), col_name("v", n)))).distinct().collect():
            for n in names:
                if row[col_name("c", n)] != "frame" or shared.setdefault(n, row[col_name("v", n)]) != row[col_name("v", n)]:
                    raise EntityComputationError(f"{n!r} must be one DataFrame for all cases of a lifted function")
        given = {n: self.frame_at(pointer) for n, pointer in shared.items()}
        cases = rows.select(F.col("p").alias("case_id"), *(F.col(col_name("v", n)).alias(n) for n in f.notes.lifts))
        try:
            made = f.call(cases=cases, **{a: maps.argument(node, given) for a, node in f.args})
        except Exception as e:
            raise EntityComputationError(f"error while computing {f.output}: {type(e).__name__}: {e}") from e
        made = made.withColumnRenamed("case_id", CASE)
        folder = self.settings.store.new_frames(self._table(f))
        path = self.settings.store.path(folder)
        # In the order of cases, so that a read of one case skips the other row groups.
        made.sortWithinPartitions(CASE).write.parquet(path)
        stored = self.spark.read.schema(made.schema).parquet(path)
        content = row_hash(stored.drop(CASE))
        hashes = stored.groupBy(F.col(CASE).alias("p")).agg(
            F.count("*").alias("n"), F.bit_xor(content).alias("x"), F.sum(content.cast("decimal(38,0)")).alias("s")
        )
        done = rows.join(hashes, "p", "left")  # cases without rows are empty frames
        name = F.sha2(F.concat_ws("|", F.lit(made.drop(CASE).schema.simpleString()), F.coalesce("n", F.lit(0)), "x", "s"), 256)
        return done.withColumn("o0", F.struct(F.lit("frame").alias("c"), F.concat(F.lit(f"{folder}#"), F.col("p")).alias("v"), name.alias("h")))

    def _on_driver(self, f: Function, into: dict, rows: DataFrame) -> DataFrame:
        """One call per case for functions of DataFrames: each call only builds a plan, which Spark runs when it is stored.

        Cases do not depend on one another, so ``AT_ONCE`` of them are given to Spark together.
        """
        cases, function = rows.collect(), self._function(f)
        if len(cases) > MANY_CASES:
            log.warning("%s has %d cases, each a plan of its own", self._table(f), len(cases))
        store = self.settings.store
        folder = store.new_frames(self._table(f)) if store.roots else ""

        def one(case) -> tuple:
            known = {}
            for _, node in f.args:
                for e in node.entities():
                    value = case[col_name("v", e)]
                    known[e] = self._gathered(value, into[e]) if e in into else self._value(case[col_name("c", e)], value)
            call = function
            if f.notes.kind == "rollup":
                call = lambda **given: self._rolled_up(f, case, given)
            try:
                got = call(**{a: maps.argument(node, known) for a, node in f.args})
            except Exception as e:
                raise EntityComputationError(f"error while computing {f.output}: {type(e).__name__}: {e}") from e
            done = []
            for k, (n, v) in enumerate(maps.leaves(f.output, got)):
                if isinstance(v, DataFrame):
                    self._frame_results.add(n)
                    if self._persisted(f):
                        # The folder's name tells outputs and schemas apart: what is below it can be one scan.
                        pointer = f"{folder}-{k}-{content_hash('schema', v.schema.json().encode())[:8]}/{CASE}={case['p']}"
                        v.write.parquet(store.path(pointer))
                        done.append(("frame", pointer, fingerprint(self.spark.read.parquet(store.path(pointer)))))
                    else:
                        pointer = f"memo:{n}:{case['p']}"
                        if self._memoized(f):
                            self.kept.append(v := v.persist())
                        self.frames[pointer] = v
                        done.append(("frame", pointer, case["p"]))
                else:
                    done.append(maps.one_result(self._codecs(f)[n], v))
            return (case["p"], *done)

        with ThreadPoolExecutor(max(1, min(AT_ONCE, len(cases)))) as pool:
            # Each thread has the request's local properties.
            out = [w.result() for w in [pool.submit(inheritable_thread_target(one), case) for case in cases]]
        is_frame = bool(self._frame_results & set(f.outputs)) or f.notes.kind in FRAME_KINDS
        codecs = self._codecs(f)
        kinds = [FRAME_RESULT if is_frame else maps.result_type(codecs[n]) for n in f.outputs]
        schema = T.StructType([T.StructField("p", T.StringType()), *(T.StructField(f"o{k}", kind) for k, kind in enumerate(kinds))])
        return self.spark.createDataFrame(out, schema).join(rows.drop(*(f"o{k}" for k in range(len(f.outputs)))), "p")

    def _rolled_up(self, f: Function, case, given: dict[str, Any]) -> DataFrame:
        """States of a ``FileSource``: those kept of the files that are still there, and new ones of the files that are not among these."""
        sources = {e: self.sources[case[col_name("v", e)]] for _, node in f.args for e in node.entities() if case[col_name("v", e)] in self.sources}
        if len(sources) != 1 or not self.settings.store.roots:
            raise EntityComputationError(f"{f.output}: a rollup takes one FileSource, and is stored")
        ((entity, source),) = sources.items()
        rest = [f"{e}={case[col_name('h', e)]}" for _, node in f.args for e in node.entities() if e != entity]
        key = content_hash("rollup", "|".join([self._identity(f), source.path, *sorted(rest)]).encode())[:32]
        by, merges = f.notes.merges
        (argument,) = (a for a, node in f.args if node == Name(entity))
        return States(self.settings.store, f"{self._table(f)}/{key}").merged(source, lambda df: f.call(**{**given, argument: df}), list(by), dict(merges))

    # --- ends

    def end_request(self, out: DataFrame | None = None) -> None:
        """Frees what was kept for one request only, and the relations built on it; with ``out``, as soon as nobody holds that any more."""
        held = [df for _, df in self.brief]
        if held:
            self.relations.clear()
            self.brief.clear()
        if out is not None and held:
            weakref.finalize(out, _unpersist, held).atexit = False
        else:
            _unpersist(held)

    def release(self) -> None:
        """Gives back what is kept in executor memory."""
        for df in self.kept:
            df.unpersist()
        self.kept.clear()

    def dag(self) -> tuple[DataFrame, DataFrame]:
        """Nodes (entity, kind, keys) and edges (source, target) of the definitions."""
        nodes, edges = [], []
        for n, d in sorted(self.state.entities.items()):
            if d.default:
                continue
            nodes.append((n, "fixed" if d.function is None else d.function.notes.kind or "python", sorted(self.keys_of(n))))
            edges += [(x, n) for x in (d.function.dependencies() if d.function else ())]
        return (
            self.spark.createDataFrame(nodes, "entity string, kind string, keys array<string>"),
            self.spark.createDataFrame(edges, "source string, target string"),
        )


def _unpersist(frames: list[DataFrame]) -> None:
    for df in frames:
        try:
            df.unpersist()
        except Exception:  # the session may have ended before the last reference
            log.debug("a cached frame could not be given back", exc_info=True)


FRAME_KINDS = ("frame", "lifted", "rollup")
FRAME_RESULT = T.StructType([T.StructField("c", T.StringType()), T.StructField("v", T.StringType()), T.StructField("h", T.StringType())])
