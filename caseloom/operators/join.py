"""The natural join of cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from .relation import Relation, col_name


def natural_join(left: Relation, right: Relation) -> Relation:
    """Rows whose shared keys are equal, unset being equal to unset; all pairs where no key is shared.

    Case tables hold parameter values and are small, so Spark broadcasts one
    side by its own size check and sort-merges beyond it.  Without a shared key
    the product is what the flow asks for: every combination of parameters.
    """
    shared = sorted(left.keys & right.keys)
    own = [n for n in right.entities if n not in left.entities]
    r = right.df
    for k in shared:
        r = r.withColumnRenamed(col_name("k", k), col_name("r", k))
    if shared:
        condition = [left.df[col_name("k", k)].eqNullSafe(r[col_name("r", k)]) for k in shared]
        df = left.df.join(r, condition, "inner")
    else:
        df = left.df.crossJoin(r)
    keys = left.keys | right.keys
    columns = [col_name("k", k) for k in sorted(keys)]
    columns += [c for n in left.entities for c in left.columns_of(n)] + [c for n in own for c in right.columns_of(n)]
    return Relation(df.select(*columns), keys, (*left.entities, *own))


def join_all(spark: SparkSession, relations: list[Relation]) -> Relation:
    """Left to right; relations that share keys are joined before those that share none."""
    if not relations:
        return Relation(spark.range(1).select(), frozenset(), ())
    first, *rest = relations
    ordered, keys = [first], set(first.keys)
    while rest:
        k = next((i for i, r in enumerate(rest) if keys & r.keys or not r.keys), 0)
        ordered.append(rest.pop(k))
        keys |= ordered[-1].keys
    return reduce(natural_join, ordered)
