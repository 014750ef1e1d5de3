"""Implausible readings per source: impossible values, spikes and stuck sensors.

Two state-space models run over each source's readings in time order. The first
is over their logarithm; its hidden level reverts to the source's robust centre,

    level[t] = centre + PHI * (level[t-1] - centre) + noise,   reading = level + noise,

where both noises share the source's robust variance. A Kalman filter forecasts
every reading; a reading whose standardised innovation exceeds ``z`` is
``surprising`` and its update is withheld. The level follows daily courses and
slow drifts, so a reading may surprise that lies within the source's usual range.
The second model forecasts that a reading repeats the last one (a random walk read
without noise, gain one); a sensor is stuck where the variance of its innovations
vanishes over ``stuck`` readings.

A spike is a surprising reading that is also far from the source's median. Why
none can hide behind a drifting level: with gain at most 1/2 and accepted
innovations of at most z standard deviations, the level stays within
z * PHI / (2 * (1 - PHI)) deviations of the centre, so with z = 3 anything further than
z * (1 + PHI / (2 * (1 - PHI))) = 6.5 robust deviations from the centre surprises.
Ten median distances are 6.745 of them.

Sources are spread by range partitioning on (source, time, id): a source that
holds a third of the rows is split into as many time-ordered pieces as its size
asks for. The filters are carried over the pieces' borders: a start is forgotten by
a factor of PHI or less a reading, so each piece hands over its last WARM readings
and its first WARM, and the border is filtered again over these alone. Results do
not depend on the pieces.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.runtime import materialize, parts_for

PHI = 0.7
STATE_SHARE = 0.5  # of a source's variance lies in the level, the rest in the reading
ROBUST = 1.4826  # standard deviations of a normal law per median distance
ROWS_PER_PIECE = 250_000
WARM = 64  # readings by which a filter has forgotten its start: 0.7 ** 64 < 2e-10, 0.5 ** 64 where none is withheld

_ROW = "source string, ts timestamp_ntz, id bigint, value bigint, centre double, spread double, innovation double, variance double, still boolean"
#: ``edge``: head or tail of a source's rows in a piece, or both; ``nth`` of the ``timed`` rows with a time
_SCHEMA = _ROW + ", piece int, edge string, nth bigint, timed bigint"


def weighted_median(hist: DataFrame, keys: list[str], value: str, weight: str, out: str, cell) -> DataFrame:
    """Median of ``value`` per key (mean of the middle two) from a histogram.

    ``cell`` is a coarse, order-keeping bucket of the value with few distinct
    results. Counts per cell tell which cell holds a middle rank; only that
    cell's values are then put in order, so no task orders a whole group.
    """
    cells = hist.withColumn("_cell", cell).groupBy(*keys, "_cell").agg(F.sum(weight).alias("_c"))
    ladder = Window.partitionBy(*keys).orderBy("_cell")
    whole = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("_c").over(ladder.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = lambda k, b, c: (F.col(b) < k) & (k <= F.col(b) + F.col(c))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    middle = (
        cells.withColumns({"_below": below, "_n": F.sum("_c").over(whole)})
        .filter(hit(low, "_below", "_c") | hit(high, "_below", "_c"))
        .drop("_c")
    )
    near = hist.withColumn("_cell", cell).join(middle, [*keys, "_cell"])
    order = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_at", F.col("_below") + F.sum(weight).over(order) - F.col(weight))
    pick = lambda k: F.max(F.when(hit(k, "_at", weight), F.col(value)))
    return placed.groupBy(*keys).agg(((pick(low) + pick(high)) / 2).alias(out))


def robust_levels(hist: DataFrame) -> DataFrame:
    """From counts (source, value, n): per source ``centre``, the log of the median
    positive reading, and ``spread``, the median distance of the logs from it."""
    hist = hist.filter("value > 0")
    med = weighted_median(hist, ["source"], "value", "n", "m", F.floor(F.log("value") * 32)).select(
        "source", F.log("m").alias("centre")
    )
    med = materialize(med)  # a row per source
    far = hist.join(med, "source").withColumn("d", F.abs(F.log("value") - F.col("centre")))
    mad = weighted_median(far, ["source"], "d", "n", "spread", F.floor(F.col("d") * 128))
    return med.join(mad, "source")


def _filter_piece(log: np.ndarray, usable: np.ndarray, centre: float, spread: float, z: float):
    """Standardised innovations of time-ordered readings of one source, from its centre on."""
    out = np.zeros(len(log))
    sigma2 = (ROBUST * spread) ** 2
    if not math.isfinite(sigma2):
        return out
    if sigma2 == 0.0:
        out[usable] = np.where(log[usable] != centre, np.inf, 0.0)
        return out
    keep = STATE_SHARE * sigma2
    noise = sigma2 - keep
    drive = keep * (1 - PHI * PHI)
    where = np.flatnonzero(usable)
    level, var = 0.0, keep
    got = []
    add, phi2, gate2 = got.append, PHI * PHI, z * z
    sqrt = math.sqrt
    for y in (log[where] - centre).tolist():
        s = var + noise
        e = y - level
        add(e / sqrt(s))
        if e * e <= gate2 * s:
            gain = var / s
            level = PHI * (level + gain * e)
            var = phi2 * (var - gain * var) + drive
        else:
            level *= PHI
            var = phi2 * var + drive
    out[where] = got
    return out


def _steadiness(value: np.ndarray, stuck: int) -> tuple[np.ndarray, np.ndarray]:
    """Of readings that follow each other: the variance of the last ``stuck`` - 1
    innovations of the forecast that nothing changes (NaN before there are as
    many), and which readings belong to a window in which it vanishes."""
    n = len(value)
    variance, still = np.full(n, np.nan), np.zeros(n, bool)
    if n >= stuck:
        innovation = (value[1:] - value[:-1]).astype(float)
        variance[stuck - 1 :] = np.convolve(innovation * innovation, np.ones(stuck - 1), "valid") / (stuck - 1)
        ends = np.flatnonzero(variance == 0)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, ends - stuck + 1, 1)
        np.add.at(change, ends + 1, -1)
        still = np.cumsum(change[:-1]) > 0
    return variance, still


def _scan(z: float, stuck: int, greatest: int):
    def run(batches):
        import pyspark

        piece = pyspark.TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        first = [True]

        def done(final: bool):
            """Work on whole sources; keep the last, perhaps unfinished one."""
            table = pa.Table.from_batches(held)
            names = table["source"].combine_chunks()
            cut = np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1
            stops = [0, *cut.tolist(), len(names)]
            held.clear()
            if not final:
                held.extend(table.slice(stops[-2]).to_batches())
                stops = stops[:-1]
            found = []
            for a, b in zip(stops[:-1], stops[1:]):
                got = _segment(table.slice(a, b - a), first[0], final and b == stops[-1])
                first[0] = False
                if got is not None:
                    found.append(got)
            return found

        def _segment(part, opens: bool, closes: bool):
            part = part.combine_chunks()
            value = part["value"].to_numpy()
            timed = part["ts"].is_valid().to_numpy(zero_copy_only=False)
            centre, spread = (part[c][0].as_py() for c in ("centre", "spread"))
            centre, spread = (math.nan if x is None else x for x in (centre, spread))
            n = len(value)
            positive = value > 0
            log = np.log(np.where(positive, value, 1).astype(float))
            inn = _filter_piece(log, positive & timed, centre, spread, z)
            loose = positive & ~timed  # no place in time: judged by the stationary law alone
            if loose.any() and math.isfinite(spread):
                sd = ROBUST * spread
                e = log[loose] - centre
                inn[loose] = e / sd if sd > 0 else np.where(e != 0, np.inf, 0.0)
            at, usable = np.flatnonzero(timed), np.flatnonzero(positive & timed)
            variance, still = np.full(n, np.nan), np.zeros(n, bool)
            variance[at], still[at] = _steadiness(value[at], stuck)
            # what the neighbouring pieces need of this one
            edge = np.full(n, None, object)
            apart = len(usable) > 2 * WARM  # head and tail don't meet
            tag = ("head", "tail") if apart or not (opens and closes) else ("both", "both")
            if opens:
                edge[usable[:WARM]] = edge[at[: stuck - 1]] = tag[0]
            if closes:
                edge[usable[-WARM:]] = edge[at[-(stuck - 1) :]] = tag[1]
            nth = np.full(n, -1, np.int64)
            nth[at] = np.arange(len(at))
            odd = (value <= 0) | (value > greatest)
            keep = odd | (np.abs(inn) > z) | still | (edge != None)  # noqa: E711
            if not keep.any():
                return None
            rows = np.flatnonzero(keep)
            part = part.take(pa.array(rows))
            return (
                part.select(["source", "ts", "id", "value", "centre", "spread"])
                .append_column("innovation", pa.array(inn[rows]))
                .append_column("variance", pa.array(variance[rows], from_pandas=True))
                .append_column("still", pa.array(still[rows]))
                .append_column("piece", pa.array(np.full(len(rows), piece, np.int32)))
                .append_column("edge", pa.array(edge[rows].tolist(), pa.string()))
                .append_column("nth", pa.array(nth[rows]))
                .append_column("timed", pa.array(np.full(len(rows), len(at), np.int64)))
            )

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= ROWS_PER_PIECE:
                    for t in done(False):
                        yield from t.to_batches()
                    size = sum(b.num_rows for b in held)
                    size = 0 if size < ROWS_PER_PIECE else size // 2
        if held:
            for t in done(True):
                yield from t.to_batches()

    return run


def _across(z: float, stuck: int):
    """The rows on the borders of a source's pieces, from the tail of one piece to
    the head of the next that is long enough to part them: both filters again. The
    innovations of a tail stay, as its piece has forgotten its own start by then."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece", "nth"], kind="stable").reset_index(drop=True)
        value, piece, nth, timed = (pdf[c].to_numpy() for c in ("value", "piece", "nth", "timed"))
        centre, spread = (float(x) if x is not None else math.nan for x in pdf.loc[0, ["centre", "spread"]])
        log = np.log(np.where(value > 0, value, 1).astype(float))
        inn = _filter_piece(log, value > 0, centre, spread, z)
        pdf["innovation"] = np.where(pdf["edge"] == "tail", pdf["innovation"], inn)
        same = piece[1:] == piece[:-1]
        follows = np.where(same, nth[1:] == nth[:-1] + 1, (nth[1:] == 0) & (nth[:-1] == timed[:-1] - 1))
        stops = [0, *(np.flatnonzero(~follows) + 1).tolist(), len(pdf)]
        variance, still = pdf["variance"].to_numpy(float, na_value=np.nan), pdf["still"].to_numpy(bool)
        for a, b in zip(stops, stops[1:]):
            v, s = _steadiness(value[a:b], stuck)
            variance[a:b] = np.where(np.isnan(v), variance[a:b], v)
            still[a:b] |= s
        pdf["variance"], pdf["still"] = variance, still
        return pdf[["source", "ts", "id", "value", "centre", "spread", "innovation", "variance", "still"]]

    return run


def flag_implausible(
    df: DataFrame,
    source: str,
    ts: str,
    id: str,
    value: str,
    greatest: int = 86_400_000,
    z: float = 3.0,
    stuck: int = 10,
    far: float = 10.0,
    pieces: int | None = None,
) -> DataFrame:
    """Implausible and surprising rows with the reason.

    Result: ``source, ts, id, value, innovation, variance, impossible, stuck, spike,
    surprising``, one row for each input row with one of the four flags.
    ``impossible``: zero, negative or above ``greatest``. ``stuck``: one of at least
    ``stuck`` readings in a row, in order of (ts, id), over which the variance of
    the innovations vanishes; ``variance`` is that of those up to the row, null
    where fewer rows came before. ``surprising``: the standardised ``innovation`` is
    beyond ``z``, so the row did not update the filter. ``spike``: surprising, and
    its log lies further from the source's median than ``far`` median distances.
    Rows without source or value are never flagged; rows without ts are judged
    for impossible values, and by their distance from the centre for the last two flags.
    Repeated rows count each. A source with no spread flags every reading off its
    median. Empty input: no rows.
    """
    spark = df.sparkSession
    readings = df.select(
        F.col(source).cast("string").alias("source"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        F.col(id).cast("bigint").alias("id"),
        F.col(value).cast("bigint").alias("value"),
    ).filter("source is not null and value is not null")
    hist = materialize(readings.groupBy("source", "value").agg(F.count(F.lit(1)).alias("n")))
    pieces = pieces or parts_for(hist.agg(F.sum("n")).first()[0] or 0, ROWS_PER_PIECE, spark.sparkContext.defaultParallelism)
    levels = materialize(robust_levels(hist))
    tagged = readings.join(levels, "source", "left")
    laid = tagged.repartitionByRange(pieces, "source", "ts", "id").sortWithinPartitions("source", "ts", "id")
    seen = materialize(laid.mapInArrow(_scan(z, stuck, greatest), _SCHEMA))

    # A border's rows: WARM of either side, whatever the size of the pieces.
    edges = seen.filter("edge is not null")
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    parted = (
        edges.groupBy("source", "piece").agg(F.max((F.col("edge") == "tail").cast("int")).alias("cut"))
        .select("source", "piece", F.coalesce(F.sum("cut").over(before), F.lit(0)).alias("border"))
    )
    border = F.col("border") + (F.col("edge") == "tail").cast("int")
    joined = edges.join(parted, ["source", "piece"]).withColumn("border", border)
    names = [c.split()[0] for c in _ROW.split(", ")]
    again = joined.groupBy("source", "border").applyInPandas(_across(z, stuck), _ROW)
    every = seen.filter("edge is null").select(*names).unionByName(again)
    surprising = F.abs("innovation") > z
    far_off = F.abs(F.log(F.when(F.col("value") > 0, F.col("value"))) - F.col("centre")) > far * F.col("spread")
    return every.select(
        "source", "ts", "id", "value", "innovation", "variance",
        ((F.col("value") <= 0) | (F.col("value") > greatest)).alias("impossible"),
        F.col("still").alias("stuck"),
        F.coalesce(surprising & far_off, F.lit(False)).alias("spike"),
        surprising.alias("surprising"),
    ).filter("impossible or stuck or spike or surprising")
