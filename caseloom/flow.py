"""Flows: frozen definitions that can be asked for values."""

from __future__ import annotations

import os
import shutil
import uuid
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import FlowBuilder, State
from .codecs import Category, bytes_of, content_hash, extension_of
from .descriptors import Name, entity_name, parse
from .errors import UnsetEntityError
from .operators import map as maps
from .operators.relation import col_name, missing
from .plans.evaluate import Evaluator, Settings
from .plans import store as files
from .plans.states import ROOT as STATES
from .plans.states import States
from .plans.store import Store, shared_root


def _shared(spark: SparkSession, root: str) -> str:
    """A store's root that the driver and all executors see: a relative one lies in the session's shared folder."""
    if "://" in root or root.startswith(("/", "file:")):
        return root
    if base := shared_root(spark):
        return f"{base.rstrip('/')}/{root}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir, or core__persistent_cache__flow_dir to a folder that all executors share")
    return os.path.abspath(root)


class Flow:
    """Immutable.  ``get`` gives Python values; ``frame`` a DataFrame of all cases."""

    def __init__(self, state: State, spark: SparkSession | None = None):
        self._state, self._spark, self._run = state, spark, uuid.uuid4().hex
        self._made: Evaluator | None = None
        self.get, self.setting = _Get(self), _Setting(self)
        plain = Evaluator(None, state, None)  # definitions are checked now, data is not touched
        for n in state.entities:
            plain.keys_of(n)

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    @property
    def _evaluator(self) -> Evaluator:
        if self._made is None:
            bare = Settings(True, False, "manual", Store(self.spark, ()), self._run)
            core = Evaluator(self.spark, self._state, bare)
            value = lambda n: self._single(core, n, None)
            root = value("core__persistent_cache__flow_dir")
            if root is None:
                root = f"{value('core__persistent_cache__global_dir')}/{value('core__flow_name')}"
            root = _shared(self.spark, str(root))
            second = value("core__persistent_cache__cloud__url")
            mode = value("core__versioning_mode")
            if mode not in ("manual", "assist", "auto"):
                raise ValueError(f"core__versioning_mode is 'manual', 'assist' or 'auto', not {mode!r}")
            store = Store(self.spark, tuple(r for r in (str(root), second) if r))
            self._made = Evaluator(
                self.spark,
                self._state,
                Settings(
                    value("core__memoize_by_default"),
                    value("core__persist_by_default"),
                    mode,
                    store,
                    self._run,
                    value("core__temp_memoize_if_uncached"),
                ),
            )
        return self._made

    @staticmethod
    def _single(core: Evaluator, name: str, default: Any) -> Any:
        rel = core.relation(name)
        rows = rel.df.where(~missing(rel.keys)).select(col_name("c", name), col_name("v", name)).take(2)
        if len(rows) > 1:
            raise ValueError(f"{name} must have one value")
        return maps.decode(*rows[0]) if rows else default

    # --- values

    def _rows(self, descriptor: str):
        node = parse(descriptor)
        for n in node.entities():
            self._state.get(n)
        rel = self._evaluator.of_node(node)
        return node, rel, rel.df.where(~missing(rel.keys))

    def _get(self, name: str, collection: Any = None, mode: Any = object) -> Any:
        out = None
        try:
            out = self._got(name, collection, mode)
            return out
        finally:
            self._evaluator.end_request(out if isinstance(out, DataFrame) else None)

    def _got(self, name: str, collection: Any, mode: Any) -> Any:
        node, rel, df = self._rows(name)
        kind = {list: "list", set: "set"}.get(collection, getattr(collection, "__name__", collection))
        kind = {"Series": "series"}.get(kind, kind)
        if kind not in (None, "list", "set", "series", "frame"):
            raise ValueError(f"unknown collection {collection!r}")
        if kind == "frame":
            return self.frame(name)
        how = {object: "object", Path: "path"}.get(mode, mode)
        if how not in ("object", "path", "filename", "FileCopier"):
            raise ValueError(f"unknown mode {mode!r}")
        try:
            rows = (df.limit(2) if kind is None else df).collect()
        except Exception as e:
            raise Evaluator._as_own(e) from e
        if kind is None:
            if not rows:
                raise UnsetEntityError(f"{name!r} has no value; unset: {self._unset(rel)}")
            if len(rows) > 1:
                raise ValueError(f"{name!r} has more than one value; ask for a collection")
        out = [self._one(node, r) if how == "object" else self._file(node, r, how) for r in rows]
        if kind is None:
            return out[0]
        if kind == "set":
            return set(out)
        if kind == "series":
            import pandas as pd

            roots = sorted(k for k in rel.keys if not self._evaluator._has_frames(k))
            values = {k: self._root_values(k, {r[col_name("k", k)] for r in rows}) for k in roots}
            index = [tuple(values[k][r[col_name("k", k)]] for k in roots) for r in rows]
            made = pd.MultiIndex.from_tuples([tuple(map(_Held, t)) for t in index], names=roots) if roots else None
            return pd.Series(out, index=made, name=name)
        return out

    def _one(self, node, row) -> Any:
        known = {n: self._evaluator._value(row[col_name("c", n)], row[col_name("v", n)]) for n in node.entities()}
        return maps.argument(node, known)

    def _root_values(self, name: str, tokens: set[str]) -> dict[str, Any]:
        """The values of a fixed entity, or of one whose cases were made from data, by their tokens."""
        d, key = self._state.get(name), col_name("k", name)
        if d.function is None:
            return {v.token: v.value for v in self._state.groups[d.group].values_of(name)}
        wanted = self.spark.createDataFrame([(t,) for t in tokens], f"`{key}` string")
        rows = self._evaluator.relation(name).df.join(wanted, key).select(key, col_name("v", name)).distinct()
        return {r[0]: maps.plain(r[1]) for r in rows.collect()}

    def _file(self, node, row, how: str) -> Any:
        if not isinstance(node, Name):
            raise ValueError("a file is of one entity")
        name = node.name
        d = self._state.get(name)
        if d.function is not None and not self._evaluator._persisted(d.function):
            raise ValueError(f"{name!r} is not persisted, but a persisted file is expected by mode {how!r}")
        codec, value = row[col_name("c", name)], row[col_name("v", name)]
        store = self._evaluator.settings.store
        own = self._evaluator._table(d.function) if d.function else name
        if codec == "frame":
            folder, _, case = value.partition("#")
            path = store.path(f"{files.FILES}/{own}/{row[col_name('h', name)]}/{name}.parquet") if case else store.locate(folder)
            if case and not files.is_complete(self.spark, path):
                self._evaluator.frame_at(value).write.mode("overwrite").parquet(path)
        else:
            if codec is None:
                codec, value = self._state.get(name).codec.encode(maps.plain(value))
            value = bytes_of(codec, value)
            digest = content_hash(codec, value) if d.function is None else row[col_name("h", name)]
            path = store.path(f"{files.FILES}/{own}/{digest}/{name}.{extension_of(codec)}")
            files.put(self.spark, path, value)
        local = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
        if how == "FileCopier":
            return FileCopier(Path(local) if "://" not in local else local, self.spark)
        if how == "path" and "://" in local:
            raise ValueError(f"{path} is on no local file system: ask for mode 'filename' or 'FileCopier'")
        return Path(local) if how == "path" else local

    def frame(self, name: str) -> DataFrame:
        """All present cases: a column for each entity that they vary with, and the value or, for a DataFrame, its columns.

        What is neither stored nor memoized stays in executor memory as long as the DataFrame is held.
        """
        out = None
        try:
            out = self._frame(name)
            return out
        finally:
            self._evaluator.end_request(out)

    def _frame(self, name: str) -> DataFrame:
        node, rel, df = self._rows(name)
        held = {k for k in rel.keys if self._evaluator._has_frames(k)}  # sources are no columns
        names = list(dict.fromkeys(node.entities()))
        roots = sorted(rel.keys - held - set(names))
        for k in roots:
            df = self._with_root(df, k)
        frames = [n for n in names if self._evaluator._has_frames(n)]
        if len(frames) > 1:
            raise ValueError(f"{frames} are DataFrames: ask for one of them at a time")
        shown = [F.col(col_name("w", k)).alias(k) for k in roots]
        if frames:
            scalars = [n for n in names if n not in frames]
            pointer = F.col(col_name("v", frames[0]))
            many = df.select(*shown, *(self._column(rel, n) for n in scalars), pointer.alias("pointer"))
            folders = [r.f for r in many.select(F.substring_index("pointer", "#", 1).alias("f")).distinct().limit(files.FANOUT + 1).collect()]
            if 0 < len(folders) <= files.FANOUT and many.where(~F.contains("pointer", F.lit("#"))).isEmpty():
                return self._evaluator.beside(many, folders, [*roots, *scalars])
            rows = df.collect()
            if not rows:
                raise UnsetEntityError(f"{name!r} has no value; unset: {self._unset(rel)}")
            given = [
                {**{k: r[col_name("w", k)] for k in roots}, **{n: maps.decode(r[col_name("c", n)], r[col_name("v", n)]) for n in scalars}}
                for r in rows
            ]
            return self._evaluator.together([r[col_name("v", frames[0])] for r in rows], given, [*roots, *scalars])
        return df.select(*shown, *(self._column(rel, n) for n in names))

    def _with_root(self, df: DataFrame, k: str) -> DataFrame:
        """With the value of an entity that the cases vary with, as a column of its own."""
        d, own, token = self._state.get(k), col_name("w", k), col_name("t", k)
        if d.function is None and d.group is None:  # unset: no present case has it
            return df.withColumn(own, F.lit(None).cast("string"))
        root = self._evaluator.relation(k)
        if root.is_typed(k):
            values = root.df.select(F.col(col_name("k", k)).alias(token), self._column(root, k).alias(own)).distinct()
        else:
            import pyarrow as pa

            rows = {v.token: str(v.value) for v in self._state.groups[d.group].values_of(k)}
            values = self.spark.createDataFrame(pa.table({"t": list(rows), "w": list(rows.values())})).toDF(token, own)
        return df.join(values, F.col(col_name("k", k)).eqNullSafe(F.col(token)))

    def _unset(self, rel) -> str:
        unset = sorted(k for k in rel.keys if rel.df.where(F.col(col_name("k", k)).isNull()).take(1))
        return ", ".join(map(repr, unset)) or "no cases"

    def _column(self, rel, name: str):
        """The value as a Spark type; codec bytes of JSON numbers and strings are read by Spark itself."""
        value = F.col(col_name("v", name))
        d = self._state.get(name)
        if rel.is_typed(name):
            if isinstance(d.codec, Category):
                return value["label"].alias(name, metadata={"ordered_categories": list(d.codec.labels)})
            return value.alias(name)
        kind = d.function.notes.returns_type if d.function else None
        text = F.when((F.col(col_name("c", name)) != "json") | (value != F.lit(b"null")), value.cast("string"))  # a null value is null
        return (F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {kind}")["v"] if kind else text).alias(name)

    def export(self, name: str, file_path=None, dir_path=None) -> Path:
        """Deprecated: ``get(name, mode='FileCopier')``."""
        import warnings

        warnings.warn("export is deprecated; use get(name, mode='FileCopier')", DeprecationWarning, stacklevel=2)
        copier = self._get(name, mode="FileCopier")
        if file_path is None and dir_path is None:
            return copier.src_file_path
        return copier.copy(file_path if file_path is not None else Path(dir_path) / str(copier.src_file_path).rpartition("/")[2])

    # --- definitions

    @property
    def name(self) -> str:
        return self._state.single("core__flow_name")

    def all_entity_names(self, include_core: bool = False) -> list[str]:
        return [n for n, d in self._state.entities.items() if include_core or not d.default and not n.startswith("core__")]

    def entity_protocol(self, name: str):
        return self._state.get(name).codec

    def entity_doc(self, name: str) -> str | None:
        return self._state.get(name).doc

    entity_docstring = entity_doc

    def to_builder(self) -> FlowBuilder:
        return FlowBuilder("", _state=self._state)

    def _changed(self, change) -> Flow:
        b = self.to_builder()
        change(b)
        return Flow(b._state, self._spark)

    def declaring(self, name: str, **options) -> Flow:
        return self._changed(lambda b: b.declare(name, **options))

    def assigning(self, name: str, *value, **options) -> Flow:
        return self._changed(lambda b: b.assign(name, *value, **options))

    def _setting(self, name: str, *value, **options) -> Flow:
        return self._changed(lambda b: b.set(name, *value, **options))

    def adding_case(self, *names_and_values) -> Flow:
        return self._changed(lambda b: b.add_case(*names_and_values))

    def then_setting(self, case: dict[str, Any], name: str, value: Any) -> Flow:
        """Adds a case and sets another entity for it."""
        return self._changed(lambda b: b.add_case(*(x for kv in case.items() for x in kv)).then_set(name, value))

    def clearing_cases(self, *names: str) -> Flow:
        return self._changed(lambda b: b.clear_cases(*names))

    def merging(self, flow: Flow, keep: str = "error", allow_name_match: bool = False) -> Flow:
        return self._changed(lambda b: b.merge(flow, keep, allow_name_match))

    # --- graph, store, memory

    def dag(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as DataFrames."""
        return self._evaluator.dag()

    def render_dag(self) -> Dot:
        """The graph in the DOT language; ``save`` writes it to a file."""
        nodes, edges = self.dag()
        lines = [f'  "{r.entity}" [shape={"box" if r.kind == "fixed" else "ellipse"}];' for r in nodes.collect()]
        lines += [f'  "{r.source}" -> "{r.target}";' for r in edges.collect()]
        return Dot("\n".join(["digraph flow {", *lines, "}"]))

    @property
    def cache(self) -> Cache:
        return Cache(self._evaluator.settings.store)

    def release(self) -> None:
        """Gives back executor memory; asking again computes again or reads the store."""
        self._evaluator.release()
        self._evaluator.relations.clear()

    def reload(self) -> None:
        """As ``reloading``, in place."""
        new = self.reloading()
        self.release()
        self._state, self._run, self._made = new._state, new._run, None

    def reloading(self) -> Flow:
        """The flow with its functions taken anew from their reloaded modules."""
        import importlib
        import sys

        b = self.to_builder()
        functions = {id(d.function): d.function for d in self._state.entities.values() if d.function}
        modules = {f.call.__module__ for f in functions.values()} - {"__main__"}
        for m in sorted(modules):
            importlib.reload(sys.modules[m])
        for f in functions.values():
            new = getattr(sys.modules.get(f.call.__module__), f.call.__name__, None)
            if new is not None and new is not f.call:
                b(new)
        return Flow(b._state, self._spark)


class Dot(str):
    def save(self, path) -> None:
        Path(path).write_text(self)


class Cache:
    """What a flow's store holds, over all its versions."""

    def __init__(self, store: Store):
        self._store = store

    def get_entries(self):
        return self._store.entries()

    def frame(self) -> DataFrame:
        return self._store.entries_frame()

    def delete(self, which: Column | DataFrame | None = None, tier: str = "local") -> int:
        """Deletes results in one commit, however many, and says how many rows went.

        ``which``: a condition on ``entity, p`` (the provenance), or a DataFrame of them; all if not given.
        """
        return self._store.delete(int(tier == "cloud"), F.lit(True) if which is None else which)

    def states(self, entity: str) -> DataFrame:
        """The states that a ``rollup`` keeps, with the ``batch`` of files that each was made from."""
        store = self._store
        kept = [States(store, f"{entity}/{key}") for key in files.folders(store.spark, store.path(f"{STATES}/{entity}"))]
        return reduce(DataFrame.unionByName, [s.rows(s.batches()) for s in kept])

    def merge(self) -> None:
        """Merges the runs of each table, and removes what earlier merges have replaced."""
        for k in range(len(self._store.roots)):
            for t in self._store.tables(k):
                self._store.merge_runs(t, k, at_least=2)


class FileCopier:
    """Copies a stored file or folder to a path, or to a URI of any file system that Spark knows."""

    def __init__(self, src_file_path: Path | str, spark: SparkSession | None = None):
        self.src_file_path, self._spark = src_file_path, spark

    def copy(self, destination) -> Path | str:
        if "://" in str(destination) or "://" in str(self.src_file_path):
            files.copy(self._spark or SparkSession.builder.getOrCreate(), str(self.src_file_path), str(destination))
            return destination
        target = Path(destination)
        if target.is_dir():
            target = target / self.src_file_path.name
        return Path((shutil.copytree if self.src_file_path.is_dir() else shutil.copy)(self.src_file_path, target))


class _Held:
    """A case value in an index: hashable and ordered whatever it is."""

    def __init__(self, value: Any):
        self._value = value

    def get(self) -> Any:
        return self._value

    def __eq__(self, other) -> bool:
        return isinstance(other, _Held) and self._value == other._value

    def __hash__(self) -> int:
        return hash(repr(self._value))

    def __lt__(self, other) -> bool:
        return self._value < other._value

    def __repr__(self) -> str:
        return repr(self._value)


class _Get:
    """``flow.get("x")`` and ``flow.get.x()``."""

    def __init__(self, flow: Flow):
        self._flow = flow

    def __call__(self, name: str, collection: Any = None, mode: Any = object) -> Any:
        return self._flow._get(name, collection, mode)

    def __getattr__(self, name: str):
        entity_name(name)
        self._flow._state.get(name)
        return lambda collection=None, mode=object: self._flow._get(name, collection, mode)

    def __dir__(self):
        return self._flow.all_entity_names()


class _Setting(_Get):
    """``flow.setting("x", 1)`` and ``flow.setting.x(1)``."""

    def __call__(self, name: str, *value, **options) -> Flow:
        return self._flow._setting(name, *value, **options)

    def __getattr__(self, name: str):
        self._flow._state.get(name)
        return lambda *value, **options: self._flow._setting(name, *value, **options)



