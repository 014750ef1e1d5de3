"""Totals and averages over trailing periods of days, idle days included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.runtime import materialize


def trailing_totals(
    df: DataFrame, entity: str, ts: str, value: str, periods: tuple[int, ...] = (7, 30)
) -> DataFrame:
    """One row per entity and day between the first and the last day of ``df``.

    Columns: ``entity, day, calls, total``, and for each period n
    ``calls_n, total_n``, ``mean_n`` (per reading that has a value; null where
    there is none) and ``daily_n`` (total over the fixed denominator n).
    Rows without entity or ts belong to no day. A null value counts as a call
    without amount. Repeated rows count each. Empty input: no rows.

    Events are added up per entity and day before the only shuffle of their
    size; from then on the data is sparse daily totals. Idle days come from a
    calendar of one row per entity holding its array of days, and the frames
    are RANGE frames over day numbers, so gaps need no filling to be right.
    """
    daily = materialize(  # a row per entity and day: the events are read once
        df.select(
            F.col(entity).alias("entity"),
            F.datediff(F.col(ts), F.lit("1970-01-01")).alias("day_no"),
            F.col(value).cast("bigint").alias("v"),
        )
        .filter("entity is not null and day_no is not null")
        .groupBy("entity", "day_no")
        .agg(F.count(F.lit(1)).alias("calls"), F.count("v").alias("readings"), F.sum("v").alias("total"))
    )
    span = daily.agg(F.min("day_no").alias("a"), F.max("day_no").alias("b"))  # one row
    calendar = (
        daily.select("entity").distinct().join(F.broadcast(span))
        .select("entity", F.explode(F.sequence("a", "b")).alias("day_no"))
        .withColumns({"calls": F.lit(0).cast("bigint"), "readings": F.lit(0).cast("bigint"), "total": F.lit(None).cast("bigint")})
    )
    dense = (
        daily.unionByName(calendar)
        .groupBy("entity", "day_no")
        .agg(F.sum("calls").alias("calls"), F.sum("readings").alias("readings"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    )
    columns = {}
    for n in periods:
        last = Window.partitionBy("entity").orderBy("day_no").rangeBetween(-(n - 1), 0)
        total, readings = F.sum("total").over(last), F.sum("readings").over(last)
        columns |= {
            f"calls_{n}": F.sum("calls").over(last),
            f"total_{n}": total,
            f"mean_{n}": F.try_divide(total.cast("double"), readings.cast("double")),
            f"daily_{n}": total.cast("double") / F.lit(float(n)),
        }
    return dense.select(
        F.col("entity"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("day_no")).alias("day"),
        "calls", "total",
        *[c.alias(name) for name, c in columns.items()],
    )
