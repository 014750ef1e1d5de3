"""Numbering, windows, caches, models, plots, files and Python functions."""

import io
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.functions import bridge, viz
from sluice.plans.frame import Err, Ok
from sluice.plans.interpreter import LIBRARIES, Interpreter, Table, row_function, table


def run_with(spark, **values):
    i = Interpreter(spark, LIBRARIES)
    for k, v in values.items():
        i.globals.set(k, v)
    return i


def test_numbers_of_rows_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    t = table(df, order_by=["k"])
    got = t.mapi("{idx: it.idx, k: it.val.k}").df.collect()
    assert sorted((r.idx, r.k) for r in got) == list(enumerate(sorted(r.k for r in df.collect())))
    plan = table(df, order_by=["k"]).slice(3, 9).df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Scan parquet")[0].replace("WindowGroupLimit", "") or "rangepartitioning" not in plan


@pytest.mark.parametrize("how", ["sem", "skew", "kurt", "nunique", "first", "last", "min", "max", "var", "median"])
def test_rolling_functions_agree_with_pandas(spark, how):
    rng = np.random.default_rng(1)
    v = [None if x < 0.1 else float(round(y, 1)) for x, y in zip(rng.random(60), rng.normal(size=60))]
    got = Table([{"i": i, "v": x} for i, x in enumerate(v)], spark=spark).add(r=f'rolling(col.v, 5, "{how}")').rows()
    s = pd.Series(v, dtype=float).rolling(5)
    want = s.apply(lambda w: w[0], raw=True) if how == "first" else s.apply(lambda w: w[-1], raw=True) if how == "last" else s.apply(lambda w: len(set(w)), raw=True) if how == "nunique" else getattr(s, how)()
    for r, w in zip(got, want):
        assert (r["r"] is None and np.isnan(w)) or r["r"] == pytest.approx(w, abs=1e-6), (how, r, w)


def test_recursive_functions_per_row(spark):
    i = run_with(spark, t=[{"n": n} for n in range(12)])
    i.run("fact = n -> match(n, <= 1: 1, _: n * fact(n - 1))")
    assert [r["f"] for r in i.run("t |> add(f: fact(it.n))").rows()] == [int(np.prod(range(1, n + 1))) for n in range(12)]
    i.run("even = n -> match(n, 0: true, _: odd(n - 1))\nodd = n -> match(n, 0: false, _: even(n - 1))")
    assert [r["e"] for r in i.run("t |> add(e: even(it.n))").rows()] == [n % 2 == 0 for n in range(12)]
    i.run('spell = n -> match(n, 0: "", _: "{spell(n - 1)}x")')
    assert [len(r["s"]) for r in i.run("t |> add(s: spell(it.n))").rows()] == list(range(12))


def test_best_rows_of_groups_as_lists(spark):
    rows = [{"g": g, "v": v, "i": i} for i, (g, v) in enumerate([("a", 1), ("a", 3), ("b", 2), ("a", 3), (None, 9), ("b", None or 0)])]
    t = Table(rows, spark=spark)
    got = {r["g"]: [x["i"] for x in r["top"]] for r in t.collapse(by="g", n="count()", top='rows -> rows |> sort(by: "v", dir: "desc") |> take(2)').rows()}
    assert got == {"a": [1, 3], "b": [2, 5]}
    assert [x["i"] for x in t.collapse(top='rows -> rows |> sort(by: "v") |> take(2)').rows()[0]["top"]] == [5, 0]
    i = Interpreter(spark, LIBRARIES)
    i.globals.set("t", rows)
    each = i.run('t |> each(by: "g", |> mapi({idx: it.idx, v: it.val.v}) |> slice(0, 1))').rows()
    assert sorted((str(r["g"]), r["idx"]) for r in each) == [("None", 0), ("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_cross_with_a_table(spark):
    i = run_with(spark, t=[{"a": 1}, {"a": 2}], m=table([{"x": 5, "y": "p"}, {"x": 6, "y": "q"}], spark).frame)
    got = i.run('t |> cross("m", m) |> add(x: it.m.x)').rows()
    assert [(r["a"], r["x"], r["m"]["y"]) for r in got] == [(1, 5, "p"), (1, 6, "q"), (2, 5, "p"), (2, 6, "q")]


def test_each_on_the_driver_takes_any_number_of_groups(spark):
    seen = []
    i = run_with(spark, t=[{"g": g} for g in range(30)], note=lambda rows: seen.append(rows) or 1)
    i.globals.set("note", lambda rows: seen.append(1))
    i.run('t |> each(by: "g", g -> note(g))')
    assert len(seen) == 30


def test_characters_of_code_points(spark):
    codes = [65, 233, 300, 0x4E16, 0x1F600, 0x10FFFF]
    t = Table([{"n": n} for n in codes] + [{"n": -1}, {"n": 0x110000}, {"n": 0xD800}], spark=spark).add(c="text.char(it.n)")
    assert [r["c"] for r in t.rows()] == [chr(n) for n in codes] and t.errors.count() == 3


def test_print_shows_all_rows(spark):
    out = io.StringIO()
    i = Interpreter(spark, LIBRARIES, out=out)
    i.globals.set("t", [{"n": n} for n in range(250)])
    i.run('t |> sort(by: "n", dir: "desc") |> print()')
    assert out.getvalue().splitlines() == [str({"n": n}) for n in range(249, -1, -1)]


def test_halt_ends_with_status_one(spark, capsys):
    with pytest.raises(SystemExit) as end:
        Interpreter(spark, LIBRARIES).run('halt("enough")')
    assert end.value.code == 1 and "enough" in capsys.readouterr().err


def test_environment_and_its_file(spark, tmp_path, monkeypatch):
    from sluice.__main__ import read_variables

    monkeypatch.delenv("SLUICE_A", raising=False)
    monkeypatch.setenv("SLUICE_B", "kept")
    p = tmp_path / ".env"
    p.write_text("# note\nSLUICE_A='one'\nexport SLUICE_B=two\n\nbroken\n")
    read_variables(str(p))
    i = Interpreter(spark, LIBRARIES)
    assert i.run("env.SLUICE_A") == "one" and i.run('env.get("SLUICE_B")') == "kept" and isinstance(i.run("env.SLUICE_NONE"), Err)
    monkeypatch.delenv("SLUICE_A")


# --- files --------------------------------------------------------------------------------


def test_csv_is_split_unless_a_quoted_line_break_asks_otherwise(spark, tmp_path):
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text("a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(2000)))
    two.write_text('a,b\n1,"two\nlines"\n2,x\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        t = table(str(one), spark)
        assert t.df.rdd.getNumPartitions() > 4 and t.df.filter("b = 'x, \"7\"'").count() == 1 and t.len() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["b"] for r in table(str(two), spark).rows()] == ["two\nlines", "x"]


def test_files_are_joined_from_parts_in_order(spark, tmp_path):
    rows = [{"k": i, "s": v} for i, v in enumerate(["plain", ' lead, and "quotes" ', "two\nlines", "", None, "é"] * 50)]
    t = Table(rows, spark=spark).sort(by="k", dir="desc")
    path = f"{tmp_path}/deep/out.csv"
    t.save(path)
    got = pd.read_csv(path, keep_default_na=False)
    assert got["k"].tolist() == list(range(299, -1, -1)) and os.listdir(f"{tmp_path}/deep") == ["out.csv"]
    assert got["s"].tolist() == [r["s"] or "" for r in rows[::-1]]
    Table([{"line": "b"}, {"line": None}, {"line": "a"}], spark=spark).save(f"{tmp_path}/o.txt")
    assert open(f"{tmp_path}/o.txt").read() == "b\n\na\n"


# --- caches and models --------------------------------------------------------------------


def test_a_changed_step_counts_as_missing(spark, tmp_path):
    folder = f"file://{tmp_path}/store"

    def go(fn):
        i = Interpreter(spark, LIBRARIES, cache_dir=folder)
        i.globals.set("f", row_function(fn))
        i.globals.set("t", [{"n": 1}, {"n": 2}])
        return sorted(r["m"] for r in i.run("t |> add(m: f(it.n)) @cache").rows()), i.store.hits

    def ten(n: int) -> int:
        return n * 10

    def other(n: int) -> int:
        return n * 11

    assert go(ten) == ([10, 20], 0) and go(ten) == ([10, 20], 1)
    assert go(other) == ([11, 22], 0)  # of the same name in the program
    steps = tmp_path / "store" / "steps"
    for key in os.listdir(steps):
        if not key.startswith("."):
            fake = spark.createDataFrame([(7, 7, 0), (8, 8, 1)], "n bigint, m bigint, __ok0 bigint")
            cols = spark.read.parquet(f"{steps}/{key}/rows").columns
            fake.toDF(*cols).write.mode("overwrite").parquet(f"{steps}/{key}/rows")
    assert go(ten) == ([10, 20], 0)


def test_written_tables_are_cleared(spark):
    from sluice import runtime

    with runtime.temporary():
        kept = runtime.materialize(spark.range(5))
        assert kept.count() == 5
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    runtime.forget(runtime.materialize(spark.range(3)))


def test_models_are_kept(spark, tmp_path):
    rows = [{"x": float(i), "z": float(i * i % 7), "y": 3.0 * i - (i * i % 7) + 1} for i in range(40)]
    i = run_with(spark, t=rows)
    for k in range(2):
        got = i.run(f't |> ml.ols(on: "y", model: "{tmp_path}/ols")')
        assert got.artifacts["ols"]["coefficients"]["x"] == pytest.approx(3) and got.artifacts["ols"]["r2"] == pytest.approx(1)
        assert all(abs(r["residual"]) < 1e-6 for r in got.rows())
        labels = i.run(f't |> ml.kmeans(k: 3, model: "file://{tmp_path}/km")')
        assert len({r["cluster"] for r in labels.rows()}) == 3
    assert sorted(os.listdir(tmp_path)) == ["km", "ols"]


# --- plots and Python functions -----------------------------------------------------------


def test_plots_carry_what_is_asked_for(spark):
    f = table([{"x": i, "y": i * i, "c": "ab"[i % 2], "l": f"p{i}"} for i in range(6)], spark).frame
    got = viz.step("scatter", f, {"x": "x", "y": "y", "color": "c", "display": {"label": "l", "legend": True, "dotsize": "y"}, "size": [4, 3], "file": None})
    data = got["data"] if isinstance(got, dict) else None
    assert data is None or (set(data[0]) == {"x", "y", "c", "l"} and len(data) == 6 and got["settings"]["size"] == [4, 3])
    line = viz.step("line", f, {"x": "x", "y": "y"})
    assert [r["y"] for r in line["data"]] == [i * i for i in range(6)]
    grid = viz.step("grid", f, {})
    assert set(grid["data"]) == {"x", "y"} and sum(b["n"] for b in grid["data"]["x"]) == 6


def test_python_functions_over_rows(spark):
    t = [{"a": 1, "s": "x"}, {"a": 2, "s": None}]
    more = bridge.add_column(t, "b", lambda r: r["a"] * 10, "bigint", spark)
    assert [r["b"] for r in more.rows()] == [10, 20]
    assert [r["a"] for r in bridge.filter_rows(more, lambda r: r["b"] > 10).rows()] == [2]
    assert bridge.map_rows(t, lambda r: {"twice": r["a"] * 2, "s": r["s"]}, "twice bigint, s string", spark).rows() == [{"twice": 2, "s": "x"}, {"twice": 4, "s": None}]

    @bridge.row(kind=int)
    def triple(n):
        return n * 3

    @bridge.whole
    def first_only(df):
        return df.filter("a = 1")

    @bridge.plain
    def invert(n):
        return 1 / n

    i = run_with(spark, t=t, triple=triple, first_only=first_only, invert=invert)
    assert [r["c"] for r in i.run("t |> add(c: triple(it.a))").rows()] == [3, 6]
    assert [r["a"] for r in i.run("t |> first_only()").rows()] == [1]
    assert i.run("invert(4)") == Ok(0.25) and isinstance(i.run("invert(0)"), Err)


def test_summary_of_steps(spark, capsys):
    i = Interpreter(spark, LIBRARIES, quiet=False)
    i.globals.set("t", [{"a": 1, "b": 2}])
    i.run('t |> add(c: it.a / it.b) |> drop("b")')
    err = capsys.readouterr().err
    assert "add" in err and "+c (errors kept apart)" in err and "2 cols -b" in err


def test_functions_of_rows_with_any_pushed_steps(spark):
    rows = [{"g": g, "v": v, "i": i} for i, (g, v) in enumerate([("a", 1), ("a", 3), ("b", 2), ("a", 3), ("b", 2)])]
    t = Table(rows, spark=spark)
    got = {r["g"]: [(x["i"], x["w"]) for x in r["u"]] for r in t.collapse(by="g", n="count()", u='rows -> rows |> unique(by: "v") |> rename(v: "w")').rows()}
    assert got == {"a": [(0, 1), (1, 3)], "b": [(2, 2)]}
    assert [x["i"] for x in t.collapse(u='rows -> rows |> unique(by: "v")').rows()[0]["u"]] == [0, 1, 2]
    ranked = t.collapse(by="g", u='rows -> rows |> add(r: rank(col.v, dir: "desc")) |> rename(r: "place")').rows()
    assert {r["g"]: [x["place"] for x in r["u"]] for r in ranked} == {"a": [3, 1, 1], "b": [1, 1]}
