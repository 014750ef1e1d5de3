"""One wide feature row per entity from typed events.

Every task first combines its events into running counters per (entity, type),
so the single shuffle carries at most one row per entity and type from each
task, however hot an entity is. The shuffle buckets by entity and sorts by
(entity, type); one pass over the sorted runs fills counters, totals and latest
times and emits the wide rows in place.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sluice.runtime import free_name, materialize

MAX_TYPES = 5_000  # wider tables belong in the long form; raises, never drops
HELD_GROUPS = 200_000  # partial groups a task holds before handing them on
WIDE_CELLS = 1_500_000  # cells of one batch of wide rows

_KEYS = ["entity", "kind"]
_SHAPE = pa.schema(
    [("entity", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("latest", pa.timestamp("us"))]
)
_PARTIAL = "entity string, kind string, n bigint, total bigint, latest timestamp_ntz"


def _shaped(columns: list) -> pa.Table:
    """One schema for fresh and for combined rows, so that they can be joined."""
    return pa.Table.from_arrays(columns, schema=_SHAPE)


def _combine(table: pa.Table) -> pa.Table:
    got = table.group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("total", "sum"), ("latest", "max")])
    return _shaped([got[c] for c in ("entity", "kind", "n_sum", "total_sum", "latest_max")])


def _partials(batches):
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            ones = pa.array(np.ones(batch.num_rows, np.int64))
            held.append(_shaped([batch["entity"], batch["kind"], ones, batch["total"], batch["latest"]]))
            rows += batch.num_rows
        if rows >= HELD_GROUPS:
            table = _combine(pa.concat_tables(held))
            held, rows = [table], table.num_rows
            if rows > HELD_GROUPS // 2:  # little left to combine here: the merge side does it
                yield from table.to_batches()
                held, rows = [], 0
    if held:
        yield from _combine(pa.concat_tables(held)).to_batches()


def _widen(kinds: list[str], names: list[str], end: int | None):
    """Wide rows from runs sorted by entity. Kinds that are not listed share the
    place after the last; ages in seconds before ``end``, in microseconds."""
    listed, places = pa.array(kinds, pa.string()), len(names) // 3
    never = np.iinfo(np.int64).min
    most = max(1, WIDE_CELLS // (3 * places))  # entities of one batch

    def rows_of(table: pa.Table):
        entity = table["entity"].combine_chunks()
        new = np.flatnonzero(pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False)) + 1
        starts = np.r_[0, new]
        row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(entity)]))
        kind = pc.fill_null(pc.index_in(table["kind"], listed), len(kinds)).to_numpy()
        n, total = (pc.fill_null(table[c], 0).to_numpy() for c in ("n", "total"))
        latest = pc.fill_null(table["latest"].cast(pa.int64()), never).to_numpy()
        for a in range(0, len(starts), most):
            size = min(most, len(starts) - a)
            at = slice(*np.searchsorted(row, [a, a + size]))
            cell = (row[at] - a) * places + kind[at]
            counts, totals, last = np.zeros(size * places, np.int64), np.zeros(size * places, np.int64), np.full(size * places, never)
            np.add.at(counts, cell, n[at])
            np.add.at(totals, cell, total[at])
            np.maximum.at(last, cell, latest[at])
            # never before a time exists: then there is no age
            age = np.where(last > never, (0 if end is None else end) - np.maximum(last, never + 1), 0) / 1e6
            counts, totals, age, none = (x.reshape(size, places) for x in (counts, totals, age, last == never))
            arrays = [entity.take(pa.array(starts[a : a + size]))]
            for i in range(places):
                arrays += [pa.array(counts[:, i].copy()), pa.array(totals[:, i].copy()), pa.array(age[:, i].copy(), mask=none[:, i].copy())]
            yield pa.RecordBatch.from_arrays(arrays, names=["entity", *names])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_shaped([batch.column(i) for i in range(5)]))
            rows += batch.num_rows
            if rows >= HELD_GROUPS:
                table = pa.concat_tables(held)
                last = pc.equal(table["entity"], table["entity"][-1])
                whole = table.filter(pc.invert(last))
                if whole.num_rows:
                    yield from rows_of(whole)
                held = [_combine(table.filter(last))]  # perhaps unfinished: at most a row per kind
                rows = held[0].num_rows
        if held:
            yield from rows_of(pa.concat_tables(held))

    return run


def typed_events(df: DataFrame, entity: str, kind: list, ts: str, value: str) -> DataFrame:
    """(entity, kind, latest, total) rows; ``kind`` joins the type columns with
    ``_``, a null part as ``none``. Rows without entity are left out."""
    parts = [F.coalesce(k.cast("string"), F.lit("none")) for k in kind]
    return df.select(
        F.col(entity).cast("string").alias("entity"),
        F.concat_ws("_", *parts).alias("kind"),
        F.col(ts).cast("timestamp_ntz").alias("latest"),
        F.col(value).cast("bigint").alias("total"),
    ).filter("entity is not null")


def event_partials(events: DataFrame) -> DataFrame:
    """Per task combined counters; safe to add up again in any grouping."""
    return events.mapInArrow(_partials, _PARTIAL)


def event_counts(df: DataFrame, entity: str, kind: list, ts: str, value: str) -> DataFrame:
    """The long form, for any number of types: ``entity, kind, n, total, age_s``,
    one row per entity and type that it has; as ``event_features`` otherwise."""
    partials = materialize(event_partials(typed_events(df, entity, kind, ts, value)))
    end = F.lit(partials.agg(F.max("latest")).first()[0]).cast("timestamp_ntz")
    got = partials.groupBy("entity", "kind").agg(F.sum("n").alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.max("latest").alias("latest"))
    return got.withColumn("age_s", F.timestamp_diff("MICROSECOND", F.col("latest"), end) / F.lit(1e6)).drop("latest")


def event_features(df: DataFrame, entity: str, kind: list, ts: str, value: str, kinds: list[str] | None = None) -> DataFrame:
    """One row per entity; for each type T seen anywhere in ``df`` the columns
    ``T_n`` (events), ``T_total`` (sum of values, null values as 0) and
    ``T_age_s`` (seconds from the entity's latest event of the type to the
    latest event of all; null where there is none with a time).

    ``kinds`` lists the types instead, so that the columns are the same for any
    data; events of all other types are put together as type ``other``.
    More than MAX_TYPES types raise an error that names the long form. A name that
    differs from another by case only gets ``_`` added. Repeated rows count each.
    Empty input: no rows, and no columns but the entity and those of ``kinds``.
    """
    partials = materialize(event_partials(typed_events(df, entity, kind, ts, value)))  # the only pass over the events
    end = partials.agg(F.max("latest")).first()[0]
    shown = kinds
    if kinds is None:
        kinds = sorted(r[0] for r in partials.select("kind").distinct().limit(MAX_TYPES + 1).collect())
        shown = []
    if len(kinds) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types: use event_counts, the long form")
    names: list[str] = []
    taken = {"entity"}
    for k in [*kinds, *(["other"] if shown else [])]:
        for part in ("n", "total", "age_s"):
            name = free_name(taken, f"{k}_{part}")
            taken.add(name.lower())
            names.append(name)
    schema = StructType([StructField("entity", StringType())])
    for i, name in enumerate(names):
        schema.add(name, DoubleType() if i % 3 == 2 else LongType())
    if not names:
        return partials.select("entity").limit(0)
    micros = None if end is None else int((end - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    laid = partials.repartition("entity").sortWithinPartitions("entity", "kind")
    return laid.mapInArrow(_widen(list(kinds), names, micros), schema)
