"""Gathers: cases grouped and collected, or aggregated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fingerprint import value_hash
from .relation import Relation, col_name, missing


def gather_keys(over: frozenset[str], also: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """(keys gathered, keys that name the groups)."""
    return over, also - over


def _grouped(rows: Relation, primary: frozenset[str], names: tuple[str, ...], aggregates: list[Column]):
    delta = sorted(rows.keys - primary)
    cols = [col_name("k", k) for k in delta]
    df = rows.df.groupBy(*cols) if cols else rows.df
    return df.agg(*aggregates), delta


def gather_frame(rows: Relation, primary: frozenset[str], names: tuple[str, ...], into: str) -> Relation:
    """One row per group with an array of the group's present cases; a group of missing cases has an empty one.

    ``collect_list`` holds a group in one row, which is what a function of the
    whole frame needs; a function of aggregates goes through ``gather_agg``.
    """
    there = ~missing(primary)
    item = F.struct(*(c for n in names for c in (F.col(col_name("h", n)), F.col(col_name("v", n)), F.col(col_name("c", n)))))
    hashes = F.sort_array(F.collect_list(F.when(there, F.concat_ws("/", *(col_name("h", n) for n in names)))))
    df, delta = _grouped(
        rows,
        primary,
        names,
        [
            F.sha2(F.concat_ws("|", hashes), 256).alias(col_name("h", into)),
            F.collect_list(F.when(there, item)).alias(col_name("v", into)),
            F.lit(None).cast("string").alias(col_name("c", into)),
        ],
    )
    return Relation(df, frozenset(delta), (into,))


def gather_agg(rows: Relation, primary: frozenset[str], names: tuple[str, ...], into: str, function: Callable, codec: str | None = None) -> Relation:
    """The function's aggregate of each group's present cases, with partial sums before the shuffle; ``codec`` names that of the result, if it has one."""
    there = ~missing(primary)
    columns = {n: F.when(there, F.col(col_name("v", n))) for n in names}
    df, delta = _grouped(rows, primary, names, [function(columns).alias(col_name("v", into))])
    df = df.withColumn(col_name("h", into), value_hash(F.col(col_name("v", into)))).withColumn(col_name("c", into), F.lit(codec).cast("string"))
    return Relation(df, frozenset(delta), (into,))


def gather_keys_of_stream(rows: Relation, primary: frozenset[str], names: tuple[str, ...], into: str) -> Relation:
    """One row per group with a hash of its present cases that is the same in any order; partial sums, and no list of them."""
    there = ~missing(primary)
    content = F.when(there, F.xxhash64(*(col_name("h", n) for n in names)))
    sums = [F.count(content).alias("n"), F.bit_xor(content).alias("x"), F.sum(content.cast("decimal(38,0)")).alias("s")]
    df, delta = _grouped(rows, primary, names, sums)
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n", "x", "s"))), 256)
    nothing = F.lit(None).cast("string")
    df = df.select(*(col_name("k", k) for k in delta), digest.alias(col_name("h", into)), nothing.alias(col_name("v", into)), nothing.alias(col_name("c", into)))
    return Relation(df, frozenset(delta), (into,))
