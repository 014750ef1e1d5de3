"""The training-data operators of the core against brute force and edge cases."""

import csv
import datetime as dt
import io
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.operators.event_features import event_counts, event_features
from sluice.operators.rejects import NULL_TOKENS, load_strict
from sluice.operators.spikes import flag_implausible
from sluice.operators.trailing import trailing_totals

FEEDS = [("a", ",", "name,age,income,region,score", 5), ("t", "\t", "region\tname\tscore\tage\tincome", 5), ("p", "|", "name|region|age|income|score|remark", 6)]


# --- rejects ------------------------------------------------------------------------------


def brute_valid(line, delim, names):
    """The record grammar, character by character."""
    if line is None or '\\"' in line:
        return False
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            value, at = "", at + 1
            while True:
                if at >= len(line):
                    return False
                if line[at] == '"':
                    if line[at + 1 : at + 2] == '"':
                        value, at = value + '"', at + 2
                        continue
                    at += 1
                    break
                value, at = value + line[at], at + 1
        else:
            end = line.find(delim, at)
            end = len(line) if end < 0 else end
            value, at = line[at:end], end
            if '"' in value or "\n" in value or "\r" in value:
                return False
        fields.append(value)
        if at == len(line):
            break
        if line[at] != delim:
            return False
        at += 1
    if len(fields) != len(names):
        return False
    row = {n: v.strip() for n, v in zip(names, fields)}
    for n, top in (("age", 120), ("income", 100_000_000)):
        v = row[n]
        if v and v.lower() not in NULL_TOKENS and not (re.fullmatch("[0-9]+", v) and int(v) <= top):
            return False
    v = row["score"]
    return not v or v.lower() in NULL_TOKENS or bool(re.fullmatch(r"[0-9]+(\.[0-9]*)?|\.[0-9]+", v) and float(v) <= 1)


def raw_table(spark, rows):
    return spark.createDataFrame(rows, "raw_id bigint, feed string, raw_line string, line string, offset int")


def feeds(spark):
    return spark.createDataFrame(FEEDS, "feed string, delim string, header string, n_fields int")


def test_strict_load_agrees_with_the_grammar(spark):
    rng = random.Random(5)
    bits = ['"', '""', '","', ",", "|", "\t", "\\", '\\"', "\n", " ", "a", "Ñ", "\x01", "\x02", "\x02a", "12", "0.5", "NA", "9e9", "1" * 30]
    rows = []
    for i in range(1500):
        feed, delim, header, n = rng.choice(FEEDS)
        if rng.random() < 0.6:
            out = io.StringIO()
            values = {"name": rng.choice(["Bo", 'Q "x"', "a,b|c", "two\nlines"]), "region": rng.choice(["EU", "", "x;y"]), "age": rng.choice(["33", " 7 ", "", "NA", "121", "٣"]),
                      "income": rng.choice(["100", "null", "100000001", "1e3"]), "score": rng.choice(["0.5", "1", ".25", "1.1", "-0.1", "nan"]), "remark": rng.choice(["", "ok"])}
            csv.writer(out, delimiter=delim, lineterminator="", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow([values[x] for x in header.split(delim)])
            line = out.getvalue()
            if rng.random() < 0.2:
                line = line[: rng.randrange(len(line))] + rng.choice(bits) + line[rng.randrange(len(line)) :]
        else:
            line = "".join(rng.choice([*bits, delim, delim]) for _ in range(rng.randrange(1, 14)))
        rows.append((i, feed, line, "clash", 0))
    got = load_strict(raw_table(spark, rows), feeds(spark))
    spec = {f: (d, h.split(d)) for f, d, h, _ in FEEDS}
    expected = {r[0] for r in rows if not brute_valid(r[2], *spec[r[1]])}
    assert {r.offset for r in got.rejects.collect()} == expected
    assert {r.offset for r in got.rows.collect()} == {r[0] for r in rows} - expected
    assert got.rejects.filter("reason = 'not loaded'").count() == 0


def test_strict_load_edges(spark):
    long = '"' + 'x""' * 200_000 + '",1,2,EU,0.5'
    rows = [(1, "a", None, "", 0), (2, None, "a,1,2,b,0.1", "", 0), (3, "zz", "a", "", 0), (4, "a", "", "", 0), (5, "a", long, "", 0), (5, "a", long, "", 0), (None, "a", "n,1,2,r,0.1", "", 0), (8, "a", ",,,,", "", 0)]
    got = load_strict(raw_table(spark, rows), feeds(spark))
    reasons = {r.offset: r.reason for r in got.rejects.collect()}
    assert reasons == {1: "missing record", 2: "unknown feed", 3: "unknown feed", 4: "too few fields", None: "missing record"}
    assert sorted(r.offset for r in got.rows.collect()) == [5, 5, 8]
    assert got.rows.filter("offset = 8 and name is null and age is null and score is null").count() == 1
    empty = load_strict(raw_table(spark, []), feeds(spark))
    assert empty.rows.count() == 0 and empty.rejects.count() == 0


def test_numbers_of_any_length(spark):
    good = ["0.30000000000000004", "0." + "3" * 40, "0" * 40 + "1", "1." + "0" * 40, ".5", "1.", "0" * 30]
    bad = ["1.0000000000000000000000000001", "1" * 40, "2", "1.5" + "0" * 30, "0x1", "."]
    rows = [(i, "a", f"n,{'0' * 25}7,1{'0' * 8},r,{v}", "", 0) for i, v in enumerate(good + bad)] + [(90, "a", "n,121,1,r,1", "", 0), (91, "a", f"n,1,{'9' * 40},r,1", "", 0)]
    got = load_strict(raw_table(spark, rows), feeds(spark))
    assert {r.offset for r in got.rejected.collect()} == {r.offset for r in got.rejects.collect()} == {*range(len(good), len(good + bad)), 90, 91}
    scores = {r.offset: r.score for r in got.rows.collect()}
    assert scores == {i: float(v) for i, v in enumerate(good)}
    reasons = {r.offset: r.reason for r in got.rejects.collect()}
    assert reasons[len(good)] == reasons[len(good) + 1] == "score out of range" and reasons[91] == "income out of range" and reasons[len(good) + 4] == "unreadable score"


# --- spikes -------------------------------------------------------------------------------


def logs(spark, rows):
    return spark.createDataFrame(rows, "log_id bigint, log_ts timestamp_ntz, service string, latency_ms int, source string, value int, piece string")


def brute_flags(rows, stuck=10):
    df = pd.DataFrame([r[:4] for r in rows], columns=["id", "ts", "service", "v"]).dropna(subset=["service", "v"])
    out = set(df.id[(df.v <= 0) | (df.v > 86_400_000)])
    for _, g in df.groupby("service"):
        pos = g[g.v > 0]
        if len(pos):
            d = np.abs(np.log(pos.v) - np.log(np.median(pos.v)))
            out |= set(pos.id[d > 10 * np.median(d)])
        t = g.dropna(subset=["ts"]).sort_values(["ts", "id"])
        run = (t.v != t.v.shift()).cumsum()
        out |= set(t.id[run.map(run.value_counts()) >= stuck])
    return out


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_spikes_match_brute_force_however_split(spark, pieces):
    rng = np.random.default_rng(3)
    start, rows, i = dt.datetime(2020, 1, 1), [], 0
    for service, n in (("hot", 2500), ("b", 400), ("flat", 60), ("few", 3)):
        level = 0.0
        for k in range(n):
            i += 1
            level = 0.9 * level + rng.normal(0, 0.1)
            v = int(np.exp(6 + level + rng.normal(0, 0.2))) if service != "flat" else 100
            if rng.random() < 0.02:
                v = int(rng.choice([0, -5, 90_000_000, v * 60, max(1, v // 60)]))
            if 700 <= k < 700 + 11 or 1200 <= k < 1200 + 9 or 100 <= k < 350 and service == "hot":
                v = 333
            ts = None if rng.random() < 0.02 else start + dt.timedelta(seconds=int(k / 3))  # ties in time
            rows.append((i, ts, service if rng.random() > 0.01 else None, v if rng.random() > 0.01 else None, "x", 1, "y"))
    got = flag_implausible(logs(spark, rows), "service", "log_ts", "log_id", "latency_ms", pieces=pieces).collect()
    ids = [r.id for r in got]
    assert len(ids) == len(set(ids)) and {r.id for r in got if r.impossible or r.stuck or r.spike} == brute_flags(rows)
    want = brute_innovations(rows, 3.0)
    assert {r.id for r in got if r.surprising} == {i for i, e in want.items() if abs(e) > 3}
    assert all(np.isclose(abs(r.innovation), abs(want[r.id]), rtol=1e-8, atol=0) for r in got if r.id in want and r.surprising)


def brute_innovations(rows, z):
    """Kalman filter over each source as a whole, reading by reading."""
    df = pd.DataFrame([r[:4] for r in rows], columns=["id", "ts", "service", "v"]).dropna(subset=["service", "v"])
    out = {}
    for _, g in df[df.v > 0].groupby("service"):
        centre = np.log(np.median(g.v))
        sd = 1.4826 * np.median(np.abs(np.log(g.v) - centre))
        level, var = 0.0, 0.5 * sd**2
        for r in g.sort_values(["ts", "id"]).itertuples():
            e = np.log(r.v) - centre
            if r.ts is pd.NaT or sd == 0:
                out[r.id] = e / sd if sd else (0.0 if e == 0 else np.inf)
                continue
            s = var + 0.5 * sd**2
            out[r.id] = (e - level) / np.sqrt(s)
            if abs(out[r.id]) <= z:
                level, var = level + var / s * (e - level), var - var * var / s
            level, var = 0.7 * level, 0.49 * var + 0.5 * sd**2 * 0.51
    return out


def test_the_filter_follows_what_a_median_cannot(spark):
    """Readings that are usual for the source but not at their time surprise, unless
    they lie towards its centre; a slow drift, a daily course and a lasting level shift
    don't; z decides."""
    rng = np.random.default_rng(8)
    start, rows, odd = dt.datetime(2020, 1, 1), [], set()
    for service, course in (
        ("drift", lambda k: 1.2 * k / 3000), ("daily", lambda k: 0.6 * np.sin(k / 3000 * 60)), ("shift", lambda k: 0.5 * (k > 1500)),
    ):
        for k in range(3000):
            i = len(rows)
            x = 6 + course(k) + rng.normal(0, 0.05)
            if k in (400, 2500):  # the other end of the usual range
                x += 1.1 if course(k) < 0.5 else -1.1
                odd.add(i)
            rows.append((i, start + dt.timedelta(minutes=k), service, int(np.exp(x)), "x", 1, "y"))
    find = lambda z: flag_implausible(logs(spark, rows), "service", "log_ts", "log_id", "latency_ms", z=z, pieces=5)
    got = find(2.0).collect()
    surprising = {r.id for r in got if r.surprising}
    assert surprising <= odd and len(surprising) >= 3 and not any(r.spike for r in got)  # no drift, course or shift by itself
    assert len({r.id for r in find(1.0).filter("surprising").collect()}) > len(surprising) > find(6.0).filter("surprising").count()


def test_stuck_sensors_by_vanishing_innovation_variance(spark):
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), "a", 500 + (i * 37) % 90 if not 300 <= i < 312 else 444, "x", 1, "y") for i in range(600)]
    got = flag_implausible(logs(spark, rows), "service", "log_ts", "log_id", "latency_ms", pieces=3).filter("stuck").collect()
    assert sorted(r.id for r in got) == list(range(300, 312))
    assert {r.id for r in got if r.variance == 0} == {309, 310, 311}  # windows of ten readings end there


def test_spikes_edges(spark):
    assert flag_implausible(logs(spark, []), "service", "log_ts", "log_id", "latency_ms").count() == 0
    nothing = [(1, None, None, None, None, None, None), (2, None, "a", None, None, None, None)]
    assert flag_implausible(logs(spark, nothing), "service", "log_ts", "log_id", "latency_ms").count() == 0
    twice = [(7, None, "a", -1, None, None, None)] * 2
    assert [r.id for r in flag_implausible(logs(spark, twice), "service", "log_ts", "log_id", "latency_ms").collect()] == [7, 7]


# --- trailing totals ----------------------------------------------------------------------


def test_trailing_totals_by_hand(spark):
    day = lambda n: dt.datetime(2020, 1, 1, 5) + dt.timedelta(days=n)
    rows = [(day(0), "a", 10), (day(0), "a", None), (day(2), "a", 20), (day(9), "b", 6), (None, "a", 1), (day(1), None, 1)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "ts timestamp_ntz, s string, v int, total int, calls int")
    got = {(r.entity, r.day.day - 1): r for r in trailing_totals(df, "s", "ts", "v", (3, 7)).collect()}
    assert len(got) == 20
    assert (got["a", 0].calls, got["a", 0].total, got["a", 0].mean_3, got["a", 0].daily_3) == (2, 10, 10.0, 10 / 3)
    assert (got["a", 2].calls_3, got["a", 2].total_3, got["a", 2].mean_3) == (3, 30, 15.0)
    assert (got["a", 3].calls, got["a", 3].total_3, got["a", 8].total_7, got["a", 9].mean_7) == (0, 20, 20, None)
    assert (got["b", 0].total_7, got["b", 9].total_7) == (0, 6)
    assert trailing_totals(df.limit(0), "s", "ts", "v").count() == 0


# --- features -----------------------------------------------------------------------------


def test_features_match_pandas(spark):
    rng = np.random.default_rng(1)
    t0 = dt.datetime(2020, 1, 1)
    rows = [
        (None if rng.random() < 0.05 else f"s{rng.integers(8) if rng.random() > 0.4 else 0}", str(rng.choice(["E", "I"])) if rng.random() > 0.1 else None,
         int(rng.integers(3)), None if rng.random() < 0.1 else t0 + dt.timedelta(seconds=int(rng.integers(10**6))), None if rng.random() < 0.1 else int(rng.integers(-5, 100)), "x", "y")
        for _ in range(3000)
    ]
    df = spark.createDataFrame(rows, "svc string, lv string, st int, ts timestamp_ntz, v int, entity string, kind string").repartition(6)
    wide = event_features(df, "svc", [F.col("lv"), F.col("st")], "ts", "v")
    got = {r.entity: r.asDict() for r in wide.collect()}
    p = pd.DataFrame(rows, columns=["svc", "lv", "st", "ts", "v", "e", "k"]).dropna(subset=["svc"])
    p["kind"] = p.lv.fillna("none") + "_" + p.st.astype(str)
    end = p.ts.max()
    assert set(got) == set(p.svc) and len(wide.columns) == 1 + 3 * p.kind.nunique()
    for (s, k), g in p.groupby(["svc", "kind"]):
        age = (end - g.ts.max()).total_seconds() if g.ts.notna().any() else None
        assert (got[s][f"{k}_n"], got[s][f"{k}_total"], got[s][f"{k}_age_s"]) == (len(g), int(g.v.fillna(0).sum()), age)
    assert event_features(df.limit(0), "svc", [F.col("lv")], "ts", "v").count() == 0
    listed = {r.entity: r for r in event_features(df, "svc", [F.col("lv"), F.col("st")], "ts", "v", kinds=["E_1", "Z_9"]).collect()}
    assert set(listed) == set(got) and len(listed["s0"]) == 10
    for s, r in listed.items():
        rest = [k for k in p.kind.unique() if k != "E_1"]
        assert (r["E_1_n"], r["Z_9_n"], r["Z_9_age_s"]) == (got[s]["E_1_n"], 0, None) and r["other_n"] == sum(got[s][f"{k}_n"] for k in rest)
        ages = [got[s][f"{k}_age_s"] for k in rest if got[s][f"{k}_age_s"] is not None]
        assert r["other_age_s"] == (min(ages) if ages else None)
    same = spark.createDataFrame([("a", "x", None, 1), ("a", "X", None, 2)], "s string, k string, ts timestamp_ntz, v int")
    assert event_features(same, "s", [F.col("k")], "ts", "v").columns == ["entity", "X_n", "X_total", "X_age_s", "x_n_", "x_total_", "x_age_s_"]
    empty = event_features(df.limit(0), "svc", [F.col("lv")], "ts", "v", kinds=["E"])
    assert empty.count() == 0 and empty.columns == ["entity", "E_n", "E_total", "E_age_s", "other_n", "other_total", "other_age_s"]
    long = {(r.entity, r.kind): (r.n, r.total, r.age_s) for r in event_counts(df, "svc", [F.col("lv"), F.col("st")], "ts", "v").collect()}
    assert all(long[s, k] == (got[s][f"{k}_n"], got[s][f"{k}_total"], got[s][f"{k}_age_s"]) for s, k in long) and len(long) == len(p.groupby(["svc", "kind"]))
    with pytest.raises(ValueError):
        many = spark.range(6000).select(F.lit("a").alias("s"), "id", F.lit(None).cast("timestamp_ntz").alias("ts"))
        event_features(many, "s", [F.col("id")], "ts", "id")


def test_features_of_a_large_task(spark):
    """More rows than a task holds at once, with few and with very many groups."""
    for groups in (50, 300_000):
        df = spark.range(700_000).coalesce(1).select(
            (F.col("id") % groups).cast("string").alias("s"), (F.col("id") % 2).alias("k"), F.lit("2020-01-01").cast("timestamp_ntz").alias("ts"), F.lit(2).alias("v")
        )
        wide = event_features(df, "s", [F.col("k")], "ts", "v")
        got = wide.agg(F.count(F.lit(1)), F.sum(F.col("0_n") + F.col("1_n")), F.sum(F.col("0_total") + F.col("1_total"))).first()
        assert tuple(got) == (groups, 700_000, 1_400_000)


def test_spikes_of_a_large_task(spark):
    """More readings than a task works on at once, stuck ones across the batches."""
    df = spark.range(620_000).select(
        F.col("id").alias("i"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") < 600_000, "hot").otherwise("b").alias("s"),
        F.when(F.col("id").between(240_000, 260_000), 777).when(F.col("id") % 100_000 == 5, 900_000).otherwise(500 + F.col("id") % 3).alias("v"),
    )
    got = flag_implausible(df, "s", "ts", "i", "v", pieces=1)
    assert {r.id for r in got.filter("stuck").select("id").collect()} == set(range(240_000, 260_001))
    assert {r.id for r in got.filter("spike and value = 900000").collect()} == {100_000 * k + 5 for k in range(7)}


def test_no_module_of_the_core_imports_llm():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "sluice"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "sluice.llm" not in f.read_text()
