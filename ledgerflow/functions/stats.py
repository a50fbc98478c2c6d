"""Global statistics compared against every row (J3) and the exact percentile behind them.

``percentile(x, p)`` in Spark is exact but merges one value->count map for the whole input in a single
final task: its memory grows with the number of distinct values, which is unbounded at scale. The exact
percentile here is distributed instead:

1. ``groupBy(value).count()`` — a map-side-combined shuffle; a value that holds a third of all rows is
   one row after it, so skew cannot concentrate work.
2. A first histogram over an order-preserving log scale (``LOG_STEPS`` buckets per power of two, so each
   bucket spans about 4.4 % of its values; the number of buckets is bounded by the double range, and for
   2-decimal money the distinct values in one bucket are bounded by its width, not by the row count).
   Its rows (bucket, rows, distinct values, min, max) return to the driver and locate the wanted ranks.
3. While a located bucket holds more than ``buckets`` distinct values, an equal-width pass over it (a
   distributed aggregate of at most ``buckets + 1`` rows) narrows it. Every pass splits the smallest value
   from the largest, so this ends.
4. The at most ``buckets`` value counts of a located bucket come to the driver, which finds the ranks.

Infinities are values of their own buckets at either end. Interpolation is linear between the two neighbouring ranks, ``lo + (hi - lo) * frac`` with
``pos = p * (n - 1)``, the same rule as DuckDB's ``quantile_cont`` and pandas' default.

It runs small Spark jobs when called (like ``DataFrame.approxQuantile``); the input should be a stored
table or a checkpointed DataFrame when it is expensive to recompute. ``method="approx"`` gives a lazy
``percentile_approx`` instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value_counts(df: DataFrame, column: str | Column) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    v = c.cast("double")
    return (
        df.select(v.alias("v"))
        .where(F.col("v").isNotNull() & ~F.isnan(F.col("v")))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("c"))
    )


LOG_STEPS = 16  # log-scale buckets per power of two
LOG_OFFSET = 20000  # > LOG_STEPS * 1074 (the smallest positive double is 2^-1074): keeps signs apart


def log_bucket(v: Column) -> Column:
    """A monotone (non-decreasing) integer bucket of a double: negative < 0 < positive, log-spaced."""
    mag = F.floor(F.log2(F.abs(v)) * F.lit(LOG_STEPS)) + F.lit(LOG_OFFSET)
    inf, end = F.lit(float("inf")), F.lit(2 * LOG_OFFSET)
    return F.when(v == inf, end).when(v == -inf, -end).when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0)).cast("long")


def exact_percentiles(
    df: DataFrame,
    column: str | Column,
    probs: Sequence[float],
    *,
    buckets: int = 1024,
) -> dict[float, float | None]:
    """Exact, linearly interpolated percentiles of ``column`` (nulls and NaN skipped)."""
    vc = _value_counts(df, column).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = (
            vc.groupBy(log_bucket(F.col("v")).alias("b"))
            .agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("b")
            .collect()
        )  # bounded by the double range: at most 2 * LOG_STEPS * 2100 + 1 rows
        n = sum(int(h["c"]) for h in first)
        if n == 0:
            return {p: None for p in probs}
        positions = {p: p * (n - 1) for p in probs}
        targets = sorted({int(math.floor(x)) for x in positions.values()} | {int(math.ceil(x)) for x in positions.values()})
        # a window: (low value, high value, rows below low value, distinct values inside, ranks inside)
        pending = []
        start = 0
        for h in first:
            mine = [r for r in targets if start <= r < start + h["c"]]
            if mine:
                pending.append((float(h["lo"]), float(h["hi"]), start, int(h["d"]), mine))
            start += int(h["c"])
        found: dict[int, float] = {}
        while pending:
            lo_v, hi_v, below, distinct, ranks = pending.pop()
            inside = vc.where(F.col("v").between(lo_v, hi_v))
            if distinct <= buckets:
                start = below
                for v, c in inside.orderBy("v").select("v", "c").collect():  # at most ``buckets`` rows
                    found.update((r, float(v)) for r in ranks if start <= r < start + c)
                    start += int(c)
                continue
            hist = (
                inside.groupBy(F.width_bucket(F.col("v"), F.lit(lo_v), F.lit(hi_v), F.lit(buckets)).alias("b"))
                .agg(
                    F.sum("c").alias("c"),
                    F.count(F.lit(1)).alias("d"),
                    F.min("v").alias("lo"),
                    F.max("v").alias("hi"),
                )
                .orderBy("b")
                .collect()
            )  # at most buckets + 1 rows
            start = below
            by_bucket: dict[int, list] = {}
            for h in hist:
                mine = [r for r in ranks if start <= r < start + h["c"]]
                if mine:
                    by_bucket[h["b"]] = [float(h["lo"]), float(h["hi"]), start, int(h["d"]), mine]
                start += int(h["c"])
            pending.extend(tuple(x) for x in by_bucket.values())
        out: dict[float, float | None] = {}
        for p, pos in positions.items():
            lo_r, hi_r = int(math.floor(pos)), int(math.ceil(pos))
            lo, hi = found[lo_r], found[hi_r]
            out[p] = lo if lo_r == hi_r else lo + (hi - lo) * (pos - lo_r)
        return out
    finally:
        vc.unpersist()


def percentile_row(
    df: DataFrame,
    column: str | Column,
    probs: Sequence[float],
    names: Sequence[str],
    *,
    method: str = "exact",
    accuracy: int = 100_000,
) -> DataFrame:
    """One-row DataFrame of percentiles; ``method="approx"`` stays lazy (``percentile_approx``)."""
    spark = df.sparkSession
    if method == "approx":
        c = F.col(column) if isinstance(column, str) else column
        arr = F.percentile_approx(c.cast("double"), list(probs), accuracy)
        return df.agg(arr.alias("_p")).select(*[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
    vals = exact_percentiles(df, column, probs)
    return spark.range(1).select(*[F.lit(vals[p]).cast("double").alias(n) for p, n in zip(probs, names)])


def with_global(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a statistics frame to every row (J3): a broadcast of one row, no shuffle of ``df``. More than one row of
    statistics is an error when the result is computed; none leaves no rows."""
    one = stats.limit(2).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("*")).alias("row"))
    several = F.raise_error(F.lit("statistics for with_global have more than one row")).cast("boolean")
    return df.crossJoin(F.broadcast(one.where(F.when(F.col("n") > 1, several).otherwise(F.col("n") == 1)).select("row.*")))
