"""The store: a log of results as Parquet, with tombstones and merged runs.

``<root>/<outputs>/w=<time>-<id>-t<tier>-<kind>/`` is a run: a row for each case that one
request computed, with its provenance, the outputs' codec, value and hash, the minor
version and the code's hash.  ``<root>/_frames/<outputs>/<write>/`` holds the rows of
stored DataFrames with their case's provenance; a value points there by a path below
the root.  A folder counts once Spark has marked it as complete, frames are written
before the rows that point to them, and of several rows of one provenance the one
that was born first counts.  So what is left of a write that was interrupted, or made
twice at one time, is never read.

Deleting writes one run of tombstones, ``<root>/_deleted/d=<time>-<id>/``: the provenance
and the run of birth of each row that no longer counts, whatever tables the rows are of.
Many small runs are merged into a larger one (``FANOUT`` of one tier into one of the
next), without the dead rows; ``_covers`` names what a merged run stands for, and is
written first, so that a merge counts with its mark and not before.  Every row is
merged a logarithmic number of times, and few runs are left to list and read.

Any Hadoop file system will do.  A second root mirrors the first: folders that
only one of them has are copied to the other when their table is used.
"""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CacheEntryDeletionError, InvalidCacheStateError

FRAMES, FILES, DELETED, CASES = "_frames", "_files", "_deleted", "_cases"
#: The provenance of the case that a row of a stored DataFrame belongs to.
CASE = "__case"
#: So many runs of one tier are merged into one of the next.
FANOUT = 16
#: Runs that a merge has replaced stay so long, for requests that had listed them.
GRACE_S = 3600
#: What is the same in all tables: the row's table, provenance and run of birth, its DataFrames' places, its outputs' hashes.
INDEX = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("p", T.StringType()),
        T.StructField("born", T.StringType()),
        T.StructField("frames", T.ArrayType(T.StringType())),
        T.StructField("hashes", T.ArrayType(T.StringType())),
    ]
)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.delete(p, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    (a, p), (b, q) = _fs(spark, source), _fs(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it is not there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return ""
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def new_name() -> str:
    """Names in the order of time, and different ones at one time."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"


def age_s(name: str) -> float:
    return time.time() - int(name.partition("=")[2].partition("-")[0]) / 1e9


def kind_of(schema: T.StructType) -> str:
    """A short name of the columns' types: runs of another kind are of another function, and are not read."""
    return hashlib.sha256(schema.simpleString().encode()).hexdigest()[:8]


def is_complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def shared_root(spark: SparkSession) -> str | None:
    """The folder that the driver and all executors share, where the session names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: under ``spark.checkpoint.dir``, or a temporary one where that is unset."""
    root = shared_root(spark)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    roots: tuple[str, ...]

    def path(self, table: str, root: int = 0) -> str:
        return f"{self.roots[root].rstrip('/')}/{table}"

    # --- runs

    def covered(self, table: str, root: int, runs: list[str]) -> set[str]:
        """Runs that a complete merged one stands for."""
        merged = [w for w in runs if _tier(w)]
        return {x for w in merged for x in read_text(self.spark, f"{self.path(table, root)}/_covers/{w}").split()}

    def writes(self, table: str, root: int) -> list[str]:
        """Complete runs of a table in one root, without those that are merged."""
        at = self.path(table, root)
        runs = [w for w in folders(self.spark, at) if w.startswith("w=") and is_complete(self.spark, f"{at}/{w}")]
        gone = self.covered(table, root, runs)
        return [w for w in runs if w not in gone]

    def is_empty(self, table: str) -> bool:
        return not any(self.writes(table, k) for k in range(len(self.roots)))

    def _rows(self, table: str, root: int, runs: list[str], schema: T.StructType) -> DataFrame:
        """Rows of runs that are not deleted."""
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*(f"{self.path(table, root)}/{w}" for w in runs))
        dead = self.tombstones(root)
        return rows if dead is None else rows.join(dead.where(F.col("entity") == table).select("p", "born"), ["p", "born"], "left_anti").select(rows.columns)

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """One row for each provenance of all roots.  A result that is in none is simply not there."""
        parts, seen, n = [], set(), 0
        for k in range(len(self.roots)):
            # A run that the first root has too is read once, unless rows were deleted there alone.
            new = [w for w in self.writes(table, k) if w.endswith(kind_of(schema)) and (w not in seen or self.graves(0))]
            seen.update(new)
            n += len(new)
            if new:
                parts.append(self._rows(table, k, new, T.StructType([*schema, INDEX["born"]])))
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = reduce(DataFrame.unionByName, parts)
        return out.drop("born") if n == 1 else _first_born(out, schema)

    def append(self, table: str, rows: DataFrame, outputs: int) -> None:
        """Written to the first root, then mirrored from it, so that a value is computed once."""
        run = f"w={new_name()}-t0-{kind_of(rows.schema)}"
        pointers = [
            F.when(F.col(f"o{k}.c") == "frame", F.col(f"o{k}.v")) if rows.schema[f"o{k}"].dataType["v"].dataType == T.StringType() else F.lit(None).cast("string")
            for k in range(outputs)
        ]
        index = {"entity": F.lit(table), "born": F.lit(run), "frames": F.array(*pointers), "hashes": F.array(*(F.col(f"o{k}.h") for k in range(outputs)))}
        rows.withColumns(index).write.parquet(f"{self.path(table)}/{run}")
        self.mirror(table)
        for k in range(len(self.roots)):
            self.merge_runs(table, k)

    def merge_runs(self, table: str, root: int, at_least: int = FANOUT) -> None:
        """Runs of one tier and kind become one of the next tier where there are so many."""
        groups: dict[tuple[int, str], list[str]] = {}
        for w in self.writes(table, root):
            groups.setdefault((_tier(w), w.rpartition("-")[2]), []).append(w)
        for (tier, kind), runs in groups.items():
            if len(runs) < at_least:
                continue
            at, run = self.path(table, root), f"w={new_name()}-t{tier + 1}-{kind}"
            names = sorted({*runs, *self.covered(table, root, runs)})
            put(self.spark, f"{at}/_covers/{run}", "\n".join(names).encode())
            schema = self.spark.read.parquet(f"{at}/{runs[0]}").schema
            _first_born(self._rows(table, root, runs, schema), schema).write.parquet(f"{at}/{run}")
        self.vacuum(table, root)

    def vacuum(self, table: str, root: int, grace_s: float = GRACE_S) -> None:
        """Removes runs that merged ones have stood for long enough."""
        at = self.path(table, root)
        runs = [w for w in folders(self.spark, at) if w.startswith("w=") and is_complete(self.spark, f"{at}/{w}")]
        for w in runs:
            if _tier(w) and age_s(w) > grace_s:
                for old in read_text(self.spark, f"{at}/_covers/{w}").split():
                    if old in runs:
                        delete(self.spark, f"{at}/{old}")

    # --- DataFrames, case tables, mirroring

    def new_frames(self, table: str) -> str:
        """Where, below the root, the DataFrames of one write go."""
        return f"{FRAMES}/{table}/{uuid.uuid4().hex}"

    def cases(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A large table of cases, kept under a name that tells its content."""
        path = self.path(f"{CASES}/{name}")
        if not is_complete(self.spark, path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def locate(self, pointer: str) -> str:
        """The path of a stored DataFrame, in the first root that has it."""
        for k in range(len(self.roots)):
            if is_complete(self.spark, self.path(pointer, k)):
                return self.path(pointer, k)
        raise InvalidCacheStateError(f"{pointer} is in no root of the store")

    def mirror(self, table: str) -> None:
        """Frames first, so that no row points to what is not there; what the other root has in a merged run is there."""
        if len(self.roots) < 2:
            return
        for k in (0, 1):
            for own in self._frames(table, k):
                self._copy(own, k)
        own = [self.writes(table, k) for k in (0, 1)]
        known = [{*w, *self.covered(table, k, w)} for k, w in enumerate(own)]
        for k in (0, 1):
            for w in own[k]:
                stands_for = self.covered(table, k, [w])
                if w not in known[1 - k] and not (stands_for and stands_for <= known[1 - k]):
                    if stands_for:
                        put(self.spark, self.path(f"{table}/_covers/{w}", 1 - k), "\n".join(sorted(stands_for)).encode())
                    self._copy(f"{table}/{w}", k)

    def _copy(self, folder: str, k: int) -> None:
        target = self.path(folder, 1 - k)
        if not is_complete(self.spark, target):
            delete(self.spark, target)  # what an interrupted copy left
            self.spark.read.parquet(self.path(folder, k)).write.parquet(target)

    def _frames(self, table: str, k: int) -> Iterator[str]:
        """Folders with complete DataFrames, below a root: a write's own, or one for each case."""
        base = f"{FRAMES}/{table}"
        for write in folders(self.spark, self.path(base, k)):
            if is_complete(self.spark, self.path(f"{base}/{write}", k)):
                yield f"{base}/{write}"
                continue
            for case in folders(self.spark, self.path(f"{base}/{write}", k)):
                if case.startswith(CASE) and is_complete(self.spark, self.path(f"{base}/{write}/{case}", k)):
                    yield f"{base}/{write}/{case}"

    def tables(self, root: int = 0) -> list[str]:
        return [t for t in folders(self.spark, self.roots[root]) if not t.startswith("_")]

    # --- the index, and deletion

    def index(self, root: int) -> DataFrame:
        """``INDEX`` of all rows of one root that count, in one scan of what all its tables have in common."""
        paths = [f"{self.path(t, root)}/{w}" for t in self.tables(root) for w in self.writes(t, root)]
        if not paths:
            return self.spark.createDataFrame([], INDEX)
        rows = self.spark.read.schema(INDEX).option("recursiveFileLookup", True).parquet(*paths)
        dead = self.tombstones(root)
        return rows if dead is None else rows.join(dead, ["entity", "p", "born"], "left_anti").select(INDEX.names)

    def entries_frame(self) -> DataFrame:
        """``tier, entity, provenance, artifact_url, write`` of all results in all roots."""
        parts = []
        for k, tier in enumerate(("local", "cloud")[: len(self.roots)]):
            rows = self.index(k).groupBy("entity", "p").agg(F.min(F.struct("born", "frames")).alias("one"))
            pointer = F.filter("one.frames", lambda x: x.isNotNull())
            base = self.path("", k)
            url = F.when(F.size(pointer) > 0, F.concat(F.lit(base), F.element_at(pointer, 1))).otherwise(F.concat(F.lit(base), "entity", F.lit("/"), "one.born"))
            parts.append(rows.select(F.lit(tier).alias("tier"), "entity", F.col("p").alias("provenance"), url.alias("artifact_url"), F.col("one.born").alias("write")))
        return reduce(DataFrame.unionByName, parts)

    def entries(self) -> list[CacheEntry]:
        found = [CacheEntry(self, r.tier, r.entity, r.provenance, r.artifact_url) for r in self.entries_frame().collect()]
        return sorted(found, key=lambda e: (e.tier, e.entity, e.provenance))

    def graves(self, root: int) -> list[str]:
        base = self.path(DELETED, root)
        return [f"{base}/{d}" for d in folders(self.spark, base) if is_complete(self.spark, f"{base}/{d}")]

    def tombstones(self, root: int) -> DataFrame | None:
        """``entity, p, born`` of the rows deleted in one root."""
        runs = self.graves(root)
        return self.spark.read.schema("entity string, p string, born string").option("recursiveFileLookup", True).parquet(*runs) if runs else None

    def delete(self, root: int, which: DataFrame | Column) -> int:
        """Deletes results of one root in one commit: those of ``entity, p`` in a table, or for which a condition on ``INDEX`` holds.

        The tombstones count first.  Then the DataFrames and copies that only dead rows had are
        removed: a folder of one case, or one of many with the last of them.
        """
        rows = self.index(root)
        dead = rows.where(which) if isinstance(which, Column) else rows.join(which.select("entity", "p").distinct(), ["entity", "p"], "left_semi")
        path = f"{self.path(DELETED, root)}/d={new_name()}"
        # What the dead rows had goes with the tombstones, so that it is known after they count.
        dead.write.parquet(path)
        gone = self.spark.read.parquet(path)
        n = gone.count()
        if n == 0:
            delete(self.spark, path)
            return 0
        left = self.index(root)
        folder = lambda df: df.select(F.explode("frames").alias("f")).where("f is not null").select(F.substring_index("f", "#", 1).alias("f")).distinct()
        for r in folder(gone).join(folder(left), "f", "left_anti").toLocalIterator():
            delete(self.spark, self.path(r.f, root))
        names = lambda df: df.select("entity", F.explode("hashes").alias("h")).distinct()
        copies = {t: set(folders(self.spark, self.path(f"{FILES}/{t}", root))) for t in folders(self.spark, self.path(FILES, root))}
        if any(copies.values()):
            for r in names(gone).join(names(left), ["entity", "h"], "left_anti").where(F.col("entity").isin(list(copies))).toLocalIterator():
                if r.h in copies[r.entity]:
                    delete(self.spark, self.path(f"{FILES}/{r.entity}/{r.h}", root))
        return n


def _tier(run: str) -> int:
    parts = run.split("-")
    return int(parts[-2][1:]) if len(parts) == 4 and parts[-2][:1] == "t" else 0


def _first_born(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Of the rows of one provenance the one that was born first."""
    rest = F.struct(*(f.name for f in schema if f.name != "p"))
    return rows.groupBy("p").agg(F.min_by(rest, "born").alias("one")).select(*(F.col("p" if f.name == "p" else f"one.{f.name}") for f in schema))


@dataclass(frozen=True)
class CacheEntry:
    """One stored result: ``tier``, ``entity`` (or the outputs of a function), ``provenance``, ``artifact_url``."""

    store: Store = field(repr=False)
    tier: str
    entity: str
    provenance: str
    artifact_url: str

    @property
    def _is_this(self) -> Column:
        return (F.col("entity") == self.entity) & (F.col("p") == self.provenance)

    def delete(self) -> bool:
        """Whether there was something to delete.  Many entries go at once by ``Cache.delete``."""
        try:
            return self.store.delete(int(self.tier == "cloud"), self._is_this) > 0
        except Exception as e:
            raise CacheEntryDeletionError(f"can't delete {self.artifact_url}: {e}") from e

    def row(self) -> dict:
        k = int(self.tier == "cloud")
        try:
            for w in self.store.writes(self.entity, k):
                rows = self.store.spark.read.parquet(f"{self.store.path(self.entity, k)}/{w}")
                if found := self.store._rows(self.entity, k, [w], rows.schema).where(self._is_this).take(1):
                    return found[0].asDict()
        except Exception as e:
            raise InvalidCacheStateError(f"{self.artifact_url} can't be read: {e}") from e
        raise InvalidCacheStateError(f"{self.artifact_url} is not there")


def provenance(parts: list) -> F.Column:
    """SHA-256 of a function's identity and its dependencies' hashes, in the order given."""
    return F.sha2(F.concat_ws("|", *parts), 256)
