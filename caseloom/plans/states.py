"""Aggregate states of files, kept with the list of the files that they were made from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..values import FileSource
from .store import FANOUT, Store, delete, folders, is_complete, new_name

ROOT = "_states"
HOW = {"sum": F.sum, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or, "hll": F.hll_union_agg}
FILE = ["path", "length", "modified"]


@dataclass(frozen=True)
class States:
    """``<root>/_states/<name>/b=<time>-<id>/``: ``rows`` are states of the files in ``files``, which is written last and makes them count."""

    store: Store
    name: str

    @property
    def base(self) -> str:
        return self.store.path(f"{ROOT}/{self.name}")

    def batches(self) -> list[str]:
        return [b for b in folders(self.store.spark, self.base) if is_complete(self.store.spark, f"{self.base}/{b}/files")]

    def files(self, batches: list[str]) -> DataFrame:
        """``path, length, modified, batch`` of the files seen; each batch is a file list of its own."""
        kinds = "path string, length long, modified double, batch string"
        if not batches:
            return self.store.spark.createDataFrame([], kinds)
        return self.store.spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(*(f"{self.base}/{b}/files" for b in batches))

    def rows(self, batches: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.store.spark.read.parquet(f"{self.base}/{b}/rows").withColumn("batch", F.lit(b)) for b in batches])

    def _write(self, rows: DataFrame, files: DataFrame) -> None:
        b = f"b={new_name()}"
        rows.write.parquet(f"{self.base}/{b}/rows")
        files.select(*FILE).withColumn("batch", F.lit(b)).write.parquet(f"{self.base}/{b}/files")

    def merged(self, source: FileSource, make: Callable[[DataFrame], DataFrame], by: list[str], merges: dict[str, str]) -> DataFrame:
        """The states of all files that there are now; only files that no state is of are read.

        A batch of which a file is gone or changed does not count any more: its other files are read again.
        """
        now, known = source.files(), self.files(self.batches())
        stale = {r.batch for r in known.join(now, FILE, "left_anti").select("batch").distinct().collect()}
        batches = [b for b in self.batches() if b not in stale]
        new = now.join(self.files(batches), FILE, "left_anti")
        paths = [r.path for r in new.select("path").collect()]  # as long as a reader's list of files
        if paths or not batches:
            rows = make(source.read(paths) if batches else source.read())
            if wrong := {*by, *merges} ^ set(rows.columns):
                raise ValueError(f"states have the columns of by and of what is merged, and no others: {sorted(wrong)}")
            self._write(rows, new)
            batches = [b for b in self.batches() if b not in stale]
        for b in stale:
            delete(self.store.spark, f"{self.base}/{b}")
        out = self._together(batches, by, merges)
        if len(batches) >= FANOUT:
            self._write(out, self.files(batches))
            for b in batches:
                delete(self.store.spark, f"{self.base}/{b}")
            out = self._together(self.batches(), by, merges)
        return out

    def _together(self, batches: list[str], by: list[str], merges: dict[str, str]) -> DataFrame:
        rows = self.rows(batches)
        return rows.groupBy(*by).agg(*(HOW[how](n).cast(rows.schema[n].dataType).alias(n) for n, how in merges.items()))
