"""Figures as values: PNG bytes of what a function draws, and sketches of DataFrames that it can draw."""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drawn(function: Callable, argument: str) -> Callable:
    """The function with matplotlib's pyplot as ``argument``; it must return None and gives the figure's PNG."""

    def draw(**given):
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot

        pyplot.close("all")
        if function(**given, **{argument: pyplot}) is not None:
            raise ValueError("a plotting function must return None")
        out = io.BytesIO()
        pyplot.savefig(out, format="png")
        pyplot.close("all")
        return out.getvalue()

    return draw


def histogram(rows: DataFrame, column: str, bins: int = 50, by: str | None = None):
    """A pandas frame of ``low, high, n`` (and ``by``): counts in ``bins`` equal parts of the column's range, nulls and NaN left out.

    Two aggregations with partial sums; what comes to the driver is as large as ``bins`` times the values of ``by``.
    """
    x = F.col(column).cast("double")
    kept = rows.where(x.isNotNull() & ~F.isnan(x))
    low, high = kept.agg(F.min(x), F.max(x)).first()
    keys = [by] if by else []
    if low is None:
        return kept.select(*keys, F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).alias("n")).limit(0).toPandas()
    width = (high - low) / bins or 1.0
    part = F.least(F.floor((x - low) / width), F.lit(bins - 1)).alias("part")
    counted = kept.groupBy(*keys, part).agg(F.count("*").alias("n")).orderBy(*keys, "part")
    edges = [(low + F.col("part") * width).alias("low"), (low + (F.col("part") + 1) * width).alias("high")]
    return counted.select(*keys, *edges, "n").toPandas()


def quantiles(rows: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), accuracy: int = 10_000):
    """A pandas frame with a row for each column: its quantiles to one part in ``accuracy``, from mergeable sketches in one pass."""
    import pandas as pd

    found = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), list(at), accuracy).alias(c) for c in columns)).first()
    return pd.DataFrame([found[c] or [None] * len(at) for c in columns], index=list(columns), columns=list(at))
