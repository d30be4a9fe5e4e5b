"""Content fingerprints: the same rows give the same hash, in any order and partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Part of every fingerprint: change it with the algorithm.
ALGORITHM = "count-sum-xor-1"


def hashable(column: Column, kind: T.DataType) -> Column:
    """Maps become sorted entries, which Spark can hash."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(column))
    if isinstance(kind, T.VariantType):
        return F.to_json(column)
    return column


def row_hash(df: DataFrame) -> Column:
    """64 bits of a row; null and its neighbours can't be mistaken for one another."""
    columns = [hashable(df[f"`{f.name}`"], f.dataType) for f in df.schema]
    return F.xxhash64(F.lit(ALGORITHM), *columns, *(c.isNull() for c in columns))


def fingerprint(df: DataFrame) -> str:
    """One aggregation with partial sums; floats must be equal to the last bit."""
    h = row_hash(df)
    n, total, xor, other = df.select(h.alias("h")).agg(
        F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h"), F.bit_xor(F.xxhash64("h"))
    ).first()
    return hashlib.sha256(repr((ALGORITHM, df.schema.simpleString(), n, str(total), xor, other)).encode()).hexdigest()


def value_hash(*columns: Column) -> Column:
    """SHA-256 of typed values, nulls told apart."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns)))), 256)
