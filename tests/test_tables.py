"""Sources, caches, models, streaming and plans."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import ml, viz
from sluice.plans.frame import Err
from sluice.plans.interpreter import LIBRARIES, Interpreter, Table, row_function, run_file, table
from sluice.streaming.rowwise import stream_steps


def test_csv_types_and_null_tokens(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('n,x,b,s,e\n1,1.5,true,"a, ""q""",\nNA,2,false,None,\n3,,true,"two\nlines",\n')
    f = table(str(p), spark)
    assert [k.simpleString() for k in f.frame.kinds().values()] == ["bigint", "double", "boolean", "string", "double"]
    assert f.rows()[0] == {"n": 1, "x": 1.5, "b": True, "s": 'a, "q"', "e": None}
    assert f.rows()[1]["n"] is None and f.rows()[1]["s"] is None and f.rows()[2]["s"] == "two\nlines"


@pytest.mark.parametrize("end", ["csv", "json", "yaml", "parquet"])
def test_round_trip(spark, tmp_path, end):
    rows = [{"a": 2, "s": "x,y"}, {"a": 1, "s": 'q"'}]
    i = Interpreter(spark)
    i.globals.set("t", rows)
    path = f"{tmp_path}/deep/er/out.{end}"
    i.run(f't |> save("{path}")')
    back = i.run(f'load("{path}")')
    assert sorted(back.rows(), key=str) == sorted(rows, key=str)
    if end == "json":
        assert json.load(open(path)) == rows


def test_text_lines(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("one\n\n  \ntwo\n")
    i = Interpreter(spark)
    assert i.run(f'load("{p}")').rows() == [{"line": "one", "index": 0}, {"line": "two", "index": 1}]
    i.run(f'load("{p}") |> save("{tmp_path}/b.txt")')
    assert (tmp_path / "b.txt").read_text() == "one\ntwo\n"
    assert isinstance(i.run('load("/none.json")'), Err)


def test_row_cache_runs_misses_only(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def slow(n: int) -> int:
        calls.add(1)
        if n == 3:
            raise ValueError("no")
        return n * 10

    def go(rows):
        i = Interpreter(spark, LIBRARIES, cache_dir=str(tmp_path / "c"))
        i.globals.set("slow", row_function(slow))
        i.globals.set("t", rows)
        return i.run("t |> add(m: slow(it.n)) @row_cache"), i.store

    f, store = go([{"n": 1}, {"n": 2}, {"n": 3}])
    assert [r["m"] for r in f.rows()] == [10, 20] and len(f.error_rows()) == 1 and store.misses == 3
    first = calls.value
    f, store = go([{"n": 2}, {"n": 1}, {"n": 3}, {"n": 4}])
    assert [r["m"] for r in f.rows()] == [20, 10, 40] and (store.hits, store.misses) == (2, 2)
    assert calls.value - first <= 4  # the failed row and the new one


def test_step_cache(spark, tmp_path):
    i = Interpreter(spark, LIBRARIES, cache_dir=str(tmp_path / "c"))
    one = i.run("[{v: 1}, {v: 2}] |> add(w: it.v * 2) @cache").rows()
    assert i.run("\n\n[{v: 1}, {v: 2}] |> add(w: it.v * 2) @cache").rows() == one and (i.store.hits, i.store.misses) == (1, 1)
    i.run("[{v: 1}, {v: 2}] |> add(w: it.v * 3) @cache")
    i.run("[{v: 1}, {v: 9}] |> add(w: it.v * 2) @cache")
    assert (i.store.hits, i.store.misses) == (1, 3)


def test_front_matter(spark, tmp_path):
    p = tmp_path / "p.flow"
    p.write_text('---\nquiet: true\ncache: true\n---\n[{v: 1}] |> add(w: it.v + 1) @cache\n')
    assert run_file(spark, str(p)).rows() == [{"v": 1, "w": 2}]
    assert (tmp_path / ".cache" / "steps").exists()


def test_models(spark):
    rows = [{"x": float(i), "y": 3.0 * i + 1, "v": [float(i % 2) * 50, float(i)]} for i in range(20)]
    t = Table(rows, spark=spark)
    fit = t.select("x", "y").ml("ols", on="y").artifacts["ols"]
    assert fit["coefficients"]["x"] == pytest.approx(3) and fit["r2"] == pytest.approx(1)
    k = t.ml("kmeans", k=range(2, 4), on="v", out="c")
    assert k.artifacts["kmeans"]["k"] == 2 and len({r["c"] for r in k.rows()}) == 2
    assert -1 <= ml.silhouette(k.frame, "c", "v") <= 1
    assert sum(b["n"] for b in viz.histogram(t.frame, "x", 5)) == 20
    assert viz.correlations(t.select("x", "y").frame)["x"]["y"] == pytest.approx(1)
    i = Interpreter(spark, LIBRARIES)
    i.globals.set("t", rows)
    assert i.run('t |> viz.histogram(x: "x", bins: 4)').artifacts["viz"]["plot"]
    assert isinstance(i.run("t |> ml.umap(dims: 2)"), Err)


def test_silhouette_takes_all_rows(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, (5000, 3)), rng.normal(2, 1, (1200, 3)), [[9.0, 9.0, 9.0]]]
    y = np.repeat([0, 1, 2], [5000, 1200, 1])
    t = table(spark.createDataFrame([(int(c), [float(u) for u in v]) for c, v in zip(y, x)], "c int, v array<double>").repartition(3), spark)
    want = ml.exact_silhouette(x, y)
    assert ml.silhouette(t.frame, "c", "v") == pytest.approx(want, abs=1e-9)
    few, ml.BLOCK_ROWS = ml.BLOCK_ROWS, 700  # many blocks
    try:
        assert ml.silhouette(t.frame, "c", "v") == pytest.approx(want, abs=1e-9)
    finally:
        ml.BLOCK_ROWS = few


def test_remote_models_by_provider(spark):
    ml.provide("llm", "fake", lambda text, s: '```json\n{"n": ' + str(len(text)) + "}\n```" if text != "bad" else "no json")
    ml.provide("embed", "fake", lambda text, s: [float(len(text)), 1.0])
    i = Interpreter(spark, LIBRARIES)
    i.globals.set("t", [{"s": "abc"}, {"s": "bad"}])
    f = i.run('ask = ml.llm("{it.s}", source: "fake", format: "json") @retry(1)\nt |> add(a: ask, e: ml.embed(it.s, source: "fake")) |> add(n: int(it.a.n))')
    assert [(r["s"], r["e"], r["n"]) for r in f.rows()] == [("abc", [3.0, 1.0], 3)] and len(f.error_rows()) == 1


def test_nested_models_in_each(spark):
    i = Interpreter(spark, LIBRARIES)
    i.globals.set("t", [{"g": g, "v": [float(x), 0.0]} for g in "ab" for x in (0, 1, 50)])
    f = i.run('t |> each(by: "g", |> ml.kmeans(k: 2, on: "v", out: "c"))')
    assert len(f.rows()) == 6 and set(f.artifacts["kmeans"]) == {"a", "b"}


def test_plans_push_down_and_stay_in_the_jvm(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("g"), F.lit("x").alias("s")).write.parquet(path)
    t = table(path, spark).filter("it.a > 10").add(b="it.a * 2").collapse(by="g", n="count()", m="sum(col.b)")
    plan = t.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,10)" in plan.split("PushedFilters")[1] and "Python" not in plan and "s#" not in plan.split("ReadSchema")[1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_streaming_rowwise_steps(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 0), (2, 4)], "a int, b int").write.parquet(str(src))
    stream = spark.readStream.schema("a int, b int").parquet(str(src))
    good, bad = stream_steps(stream, '|> add(q: it.a / it.b) |> filter(it.q < 1) |> drop("a")')
    got = []
    q = good.writeStream.foreachBatch(lambda df, _: got.extend(r.asDict() for r in df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert got == [{"b": 4, "q": 0.5}] and bad is not None
    with pytest.raises(Exception, match="stream"):
        stream_steps(stream, '|> sort(by: "a")')
