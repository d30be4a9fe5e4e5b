"""What the operators share: batch mapping, the shared scratch folder, digests."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch put out by the Python stages.
OUT_ROWS = 4096
#: Rows that they turn into Python objects at once.
IN_ROWS = 500


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a session
    without it (tests on one machine) gets a temporary folder, set once.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        root = _own.setdefault(id(spark.sparkContext), "") or tempfile.mkdtemp(prefix="spark-scratch-")
        _own[id(spark.sparkContext)] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_own: dict[int, str] = {}


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send rows to Python in batches of ``rows``: what a worker holds is bounded where rows are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: What a Python worker keeps from task to task, by name.
_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a worker; what a worker kept under another name goes."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Freed blocks that the worker's earlier stages left with Arrow's and the C library's allocators go back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def begin_stage() -> None:
    """For stages that keep nothing in the worker: what earlier ones kept goes."""
    _kept.clear()
    give_back()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples of Python values, a part of a batch at a time; begins by giving back memory that the worker's last stage left."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, IN_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, IN_ROWS).columns))


def map_rows(
    df: DataFrame,
    columns: list[str],
    fn: Callable[..., Iterable[tuple]],
    schema: str,
) -> DataFrame:
    """Maps rows in Arrow batches: ``fn(*column values)`` gives an iterable of output tuples."""
    kinds = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for values in rows_of(batches):
            rows.extend(fn(*values))
            if len(rows) >= OUT_ROWS:
                yield to_batch(rows, arrow)
                rows = []
        if rows:
            yield to_batch(rows, arrow)

    return df.select(*columns).mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema],
        schema=schema,
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
