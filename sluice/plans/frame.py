"""The table value: a lazy DataFrame with row order, an error table and artifacts.

Row order is part of the language. It is carried by hidden columns (``__o...``),
added only when an order-sensitive step asks for them, so plain scans keep their
filter push-down and nothing is sorted before output. Inside ``each`` a frame
knows its group keys and every step partitions by them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.values import PipeError
from sluice.runtime import materialize, shuffle_partitions

HIDDEN = "__o"


@dataclass(frozen=True)
class Ok:
    value: object


@dataclass(frozen=True)
class Err:
    msg: str
    cause: object = None


def hidden(name: str) -> bool:
    return name.startswith(HIDDEN)


@dataclass(frozen=True)
class Frame:
    data: DataFrame
    order: tuple[tuple[str, bool], ...] = ()  # hidden column, ascending
    errors: DataFrame | None = None
    artifacts: dict = field(default_factory=dict)
    ordered: bool = True  # False: the source promises no order, so none is carried
    within: tuple[str, ...] = ()  # hidden group columns inside each

    # -- structure --
    @property
    def columns(self) -> list[str]:
        return [c for c in self.data.columns if not hidden(c)]

    @property
    def secret(self) -> list[str]:
        return [c for c in self.data.columns if hidden(c)]

    def kinds(self) -> dict:
        return {f.name: f.dataType for f in self.data.schema.fields if not hidden(f.name)}

    def with_data(self, data: DataFrame, **changes) -> Frame:
        return replace(self, data=data, **changes)

    def with_artifact(self, name: str, value) -> Frame:
        return replace(self, artifacts={**self.artifacts, name: value})

    def fresh(self, stem: str = "k") -> str:
        n = 0
        while f"{HIDDEN}{stem}{n}" in self.data.columns:
            n += 1
        return f"{HIDDEN}{stem}{n}"

    # -- order --
    def sequenced(self) -> Frame:
        """With order columns: the scan's order where none was given yet."""
        if self.order:
            return self
        name = self.fresh()
        return replace(self, data=self.data.withColumn(name, F.monotonically_increasing_id()), order=((name, True),))

    def kept(self) -> Frame:
        """Before a shuffle: as ``sequenced`` where the source has an order."""
        return self.sequenced() if self.ordered else self

    def order_cols(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in self.order]

    def visible(self) -> DataFrame:
        """The rows in order, without hidden columns."""
        df = self.data.orderBy(*self.order_cols()) if self.order else self.data
        return df.select(*[F.col(f"`{c}`") for c in self.columns])

    def unordered(self) -> DataFrame:
        return self.data.select(*[F.col(f"`{c}`") for c in self.columns])

    def rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.visible().collect()]

    def error_rows(self) -> list[dict]:
        return [] if self.errors is None else [r.asDict(recursive=True) for r in self.errors.collect()]

    def add_errors(self, more: DataFrame | None) -> DataFrame | None:
        if more is None or self.errors is None:
            return self.errors if more is None else more
        return self.errors.unionByName(more, allowMissingColumns=True)

    # -- positions --
    def indexed(self, name: str) -> Frame:
        """Adds ``name``, each row's place from 0. Without groups the rows are
        range-partitioned and sorted by their order, numbered as they are written
        and shifted by the sizes of the partitions before: one shuffle, and no
        task gets all."""
        f = self.sequenced()
        if f.within:
            w = Window.partitionBy(*f.within).orderBy(*f.order_cols())
            return replace(f, data=f.data.withColumn(name, (F.row_number().over(w) - 1).cast("bigint")))
        return replace(f, data=numbered(f.data, f.order_cols(), name))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    part, base = f"{HIDDEN}part", f"{HIDDEN}base"
    sorted_ = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    # the number holds the partition above 33 bits and the place in it below
    laid = materialize(sorted_.withColumn(name, F.monotonically_increasing_id())).withColumn(part, F.shiftright(name, 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy(part).count()  # one row per partition
    bases = sizes.select(part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    placed = laid.join(F.broadcast(bases), part)
    return placed.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(base)).drop(part, base)


def _running(batches):
    """Adds to sorted (value, count) rows of a partition the counts before each."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        if batch.num_rows:
            n = batch.column(1).to_numpy()
            before = np.cumsum(n) - n + total
            total += int(n.sum())
            parts = pa.array(np.full(batch.num_rows, part, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), parts], names=["_v", "_n", "_in", "_part"])


def ranked(df: DataFrame, value: str, descending: bool, name: str) -> DataFrame:
    """SQL RANK over the whole table: distinct values with their counts are
    numbered as in ``numbered``, then joined back."""
    counts = df.groupBy(F.col(f"`{value}`").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    key = F.col("_v").desc() if descending else F.col("_v").asc()
    sorted_ = counts.repartitionByRange(shuffle_partitions(df.sparkSession), key).sortWithinPartitions(key)
    schema = T.StructType([*counts.schema.fields, T.StructField("_in", T.LongType()), T.StructField("_part", T.LongType())])
    laid = materialize(sorted_.mapInArrow(_running, schema))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("_part").agg(F.sum("_n").alias("_size"))  # one row per partition
    bases = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    table = laid.join(F.broadcast(bases), "_part").select("_v", (F.col("_in") + F.col("_base") + 1).alias(name))
    return df.join(table, df[f"`{value}`"].eqNullSafe(table["_v"]), "left").drop("_v")


def single(df: DataFrame) -> Column:
    """The only value of a one-row, one-column table, as a scalar subquery."""
    return df.scalar()


def as_frame(spark, value) -> Frame:
    """A table from a Frame, a DataFrame or a list of objects."""
    if isinstance(value, Ok):
        value = value.value
    if isinstance(value, Frame):
        return value
    if isinstance(value, DataFrame):
        return Frame(value, ordered=False)
    if isinstance(value, dict):
        value = [value]
    if isinstance(value, (list, tuple)) and all(isinstance(r, dict) for r in value):
        return from_rows(spark, list(value))
    raise PipeError(f"expected a table, got {type(value).__name__}")


def from_rows(spark, rows: list[dict]) -> Frame:
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not rows or not names:
        return Frame(spark.createDataFrame([], f"`{HIDDEN}k0` bigint"), ((f"{HIDDEN}k0", True),))
    columns = {n: [r.get(n) for r in rows] for n in names}
    for n, values in columns.items():  # whole numbers beside real ones become real
        if any(isinstance(v, float) for v in values):
            columns[n] = [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in values]
        if all(v is None for v in values):
            columns[n] = [None] * len(rows)
    data = [(*[columns[n][i] for n in names], i) for i in range(len(rows))]
    fields = []
    for n in names:
        kind = _kind_of(columns[n])
        fields.append(T.StructField(n, kind))
    schema = T.StructType([*fields, T.StructField(f"{HIDDEN}k0", T.LongType())])
    return Frame(spark.createDataFrame(data, schema), ((f"{HIDDEN}k0", True),))


def _kind_of(values):
    real = [v for v in values if v is not None]
    if not real:
        return T.StringType()
    kinds = {type(v) for v in real}
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int, bool}:
        return T.LongType()
    if kinds <= {int, float, bool}:
        return T.DoubleType()
    if kinds <= {str}:
        return T.StringType()
    if kinds <= {list, tuple}:
        return T.ArrayType(_kind_of([x for v in real for x in v]))
    if kinds <= {dict}:
        keys = list(dict.fromkeys(k for v in real for k in v))
        return T.StructType([T.StructField(k, _kind_of([v.get(k) for v in real])) for k in keys])
    raise PipeError("a column holds values of different types: " + ", ".join(sorted(k.__name__ for k in kinds)))
