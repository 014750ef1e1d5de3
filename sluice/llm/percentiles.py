"""Exact percentiles per group by bisection.

For each group and wanted percentile an interval of values is kept that holds
the target rank. Every pass counts, with one map-side combined aggregation, the
rows that fall into the equal cells of the open intervals, and replaces each
interval by the one cell in which its target rank lies. ``CELLS`` midpoints are
counted in a pass, so 32-bit values are resolved in a handful of passes. No
group's values are ever gathered: a pass shuffles at most CELLS counts per open
interval, however large or hot the group is.

Counts add up, so day or partition summaries ((group, value) -> n) are resolved
together by the same passes: give their count column as ``weight``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.runtime import forget, materialize

CELLS = 256
PERCENTS = (50, 90, 95, 99)


def summarize(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys..., value, n``: the mergeable summary of one day or partition. Rows
    without a value are left out. A null key is a key of its own, so readings
    without a day are not lost when days are put together."""
    return (
        df.select(*keys, F.col(value).alias("value")).filter("value is not null")
        .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    )


def _given(keys, value):
    wanted = F.col(value).isNotNull()
    for k in keys:
        wanted &= F.col(k).isNotNull()
    return wanted


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percents: Sequence[int] = PERCENTS,
    weight: str | None = None,
    tolerance: float = 0,
) -> DataFrame:
    """``keys..., n`` and one column ``pXX`` per percent.

    The percentile p of n values is the value of rank ceil(n * p / 100). The
    result lies at most ``tolerance`` above the exact value, so by default it
    is exact, for whole numbers and for doubles. Rows with a null key, a null
    or a NaN value, or a weight below one are left out; repeated rows count
    each. Empty input: no rows. Infinite values are refused by an error.
    """
    kind = dict(df.dtypes)[value]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    number = "bigint" if whole else "double"
    names = {k: f"k{i}" for i, k in enumerate(keys)}
    ks = list(names.values())
    rows = df.select(
        *[F.col(k).alias(a) for k, a in names.items()],
        F.col(value).cast(number).alias("v"),
        (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("w"),
    ).filter(_given(ks, "v") & (F.col("w") > 0))
    if not whole:
        rows = rows.filter(~F.isnan("v")).withColumn(
            "v", F.when(F.abs("v") == float("inf"), F.raise_error(F.lit("infinite value"))).otherwise(F.col("v"))
        )
    bounds = rows.groupBy(*ks).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("n"))
    state = materialize(
        bounds.select(*ks, "n", "lo", "hi", F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("pc"))
        .withColumn("rank", F.expr("(n * pc + 99) div 100"))
        .withColumn("below", F.lit(0).cast("bigint"))  # rows under the interval
    )
    while True:
        is_open = (F.col("hi") > F.col("lo")) if not tolerance else (F.col("hi") / 2 - F.col("lo") / 2 > tolerance / 2)
        if state.filter(is_open).isEmpty():
            break
        state, was = materialize(_narrow(rows, state, ks, is_open, whole)), state
        forget(was)
    return (
        state.groupBy(*ks)
        .agg(F.first("n").alias("n"), *[F.max(F.when(F.col("pc") == p, F.col("hi"))).alias(f"p{p}") for p in percents])
        .select(*[F.col(a).alias(k) for k, a in names.items()], "n", *[f"p{p}" for p in percents])
    )


def _narrow(rows: DataFrame, state: DataFrame, ks: list[str], is_open, whole: bool) -> DataFrame:
    """One pass: count cells of the open intervals, keep the cell of each rank.

    The kept interval runs from the cell's least to its greatest value, so it
    holds the cell's rows and no others, whatever the rounding of its borders.
    """
    if whole:
        near = (F.col("lo") > -(2**62)) & (F.col("hi") < 2**62)
        width = F.when(near, F.expr(f"greatest(1L, (hi - lo + {CELLS}) div {CELLS})")).otherwise(
            F.expr(f"hi div {CELLS} - lo div {CELLS} + 1")
        )
        cell = F.expr("v div width - lo div width")
    else:
        width = F.col("hi") / 2 - F.col("lo") / 2
        cell = F.floor((F.col("v") / 2 - F.col("lo") / 2) / F.col("width") * (CELLS - 1))
    todo = state.filter(is_open)
    spans = todo.select(*ks, "lo", "hi", width.alias("width")).distinct()
    # shuffled or broadcast as the measured size of the interval table asks for
    on = [F.col(f"r.{k}") == F.col(f"s.{k}") for k in ks] + [F.col("r.v").between(F.col("s.lo"), F.col("s.hi"))]
    counts = (
        rows.alias("r").join(spans.alias("s"), on)
        .select(*[F.col(f"r.{k}") for k in ks], "lo", "hi", "v", cell.cast("bigint").alias("cell"), "w")
        .groupBy(*ks, "lo", "hi", "cell").agg(F.sum("w").alias("c"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    )
    upto = Window.partitionBy(*ks, "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    ladder = counts.withColumn("cum", F.sum("c").over(upto))
    at = [F.col(f"t.{k}") == F.col(f"l.{k}") for k in ks] + [
        F.col("t.lo") == F.col("l.lo"), F.col("t.hi") == F.col("l.hi"),
        F.col("t.below") + F.col("l.cum") - F.col("l.c") < F.col("t.rank"),
        F.col("t.rank") <= F.col("t.below") + F.col("l.cum"),
    ]
    moved = todo.alias("t").join(ladder.alias("l"), at).select(
        *[F.col(f"t.{k}") for k in ks], "t.n", F.col("v0").alias("lo"), F.col("v1").alias("hi"), "t.pc", "t.rank",
        (F.col("t.below") + F.col("l.cum") - F.col("l.c")).alias("below"),
    )
    return state.filter(~is_open).unionByName(moved)
