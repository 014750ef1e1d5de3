"""Queries of sources and sinks, of the grammar's forms and of what a program can
use: files, modules, caches, annotations, models, plots. Each with its SQL."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from sluice.functions import ml, viz
from sluice.plans.frame import as_frame
from sluice.plans.interpreter import LIBRARIES, Interpreter, Table, run_file
from sluice.queries.core import QUERIES, SQL, load, program, query  # noqa: F401
from sluice.runtime import scratch

HERE = Path(__file__).parent


# --- sources and sinks --------------------------------------------------------------------

_ORDERS = "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders"


def _round_trip(spark, d, end):
    path = f"{scratch(spark)}.{end}"
    load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").save(path)
    return Interpreter(spark, LIBRARIES).run(f'load("{path}")').unordered()


@query(_ORDERS)
def csv_round_trip(spark, d):
    return _round_trip(spark, d, "csv")


@query(_ORDERS)
def json_round_trip(spark, d):
    return _round_trip(spark, d, "json")


@query(_ORDERS)
def parquet_round_trip(spark, d):
    return _round_trip(spark, d, "parquet")


@query("select container_kind, capacity_tokens from containers")
def yaml_round_trip(spark, d):
    path = f"{scratch(spark)}.yaml"
    load(spark, d, "containers").select("container_kind", "capacity_tokens").save(path)
    return Interpreter(spark, LIBRARIES).run(f'load("{path}")').unordered()


@query("select p_name as line, count(*) as n from part group by 1")
def txt_round_trip(spark, d):
    path = f"{scratch(spark)}.txt"
    load(spark, d, "part").select(line="it.p_name").save(path)
    t = Table(Interpreter(spark, LIBRARIES).run(f'load("{path}")'))
    assert t.frame.columns == ["line", "index"]
    return t.collapse(by="line", n="count()").df


@query("select a, b, cast(c as double) as c from (values (1, 'x', 2.5), (2, null, 3.0), (3, 'z', null)) t(a, b, c)")
def list_literal(spark, d):
    return program(spark, d, '[{a: 1, b: "x", c: 2.5}, {a: 2, c: 3}, {a: 3, b: "z"}] |> select("a", "b", "c")').withColumn("a", F.col("a").cast("int"))


# --- values -------------------------------------------------------------------------------


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linenumber as n, cast(l_linenumber * (l_linenumber + 1) / 2 as bigint) as total from lineitem")
def range_values(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", n="len(1..it.l_linenumber)", total="math.sum(1..it.l_linenumber)"
    ).df.withColumn("total", F.col("total").cast("bigint"))


@query("select vec_id, cast(1.5 as double) as a, round(cast(embedding[2] as double), 6) as b, cast(-1 as double) as c, len(embedding) as n from embeddings")
def list_set(spark, d):
    t = Table(load(spark, d, "embeddings").df.withColumn("e", F.col("embedding").cast("array<double>")))
    t = t.add(s="set(set(it.e, 0, 1.5), 63, 0 - 1.0)").select("vec_id", a="it.s[0]", b="it.s[1]", c="it.s[63]", n="len(it.s)")
    return t.df.withColumn("b", F.round("b", 6))


@query("select o_orderkey, -o_totalprice as minus, -o_custkey as less from orders where not (o_totalprice > 100000) and not (o_orderstatus = 'F')")
def not_and_minus(spark, d):
    return load(spark, d, "orders").filter('not (it.o_totalprice > 100000) and not (it.o_orderstatus == "F")').select(
        "o_orderkey", minus="-it.o_totalprice", less="-it.o_custkey"
    ).df


@query("select p_partkey, p_name as bare, cast(len(string_split(trim(p_name), ' ')) as bigint) as n from part")
def text_blanks(spark, d):
    return load(spark, d, "part").select("p_partkey", bare='text.trim(" \\t\u00a0" + it.p_name + "\u3000\\n ")', n='len(text.split("  " + it.p_name + " "))').df


# --- forms of the grammar -----------------------------------------------------------------


@query("select n_nationkey, sum(c_acctbal > 5000) as rich, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def program_forms(spark, d):
    """Comments, newlines within brackets, blocks, shorthand, spread, leading pipes, several statements on a line."""
    return program(spark, d, """
# a comment
limit = 5000; wealthy = x -> (
  y = x - limit
  match(y, > 0: 1, _: 0)
)
nations = load($nation)

load($customer)   # the pipe goes on below
  |> filter(
       it.c_nationkey >= 0 and
       it.c_acctbal == it.c_acctbal
     )
  |> map({...it, n_nationkey: it.c_nationkey,
          limit})
  |> join(nations, on: "n_nationkey")
  |> add(w: wealthy(it.c_acctbal))
  |> collapse(by: "n_nationkey", rich: sum(col.w), n: count(),)
""")


@query("select s_suppkey, s_acctbal + 10 + 3 as a, (s_acctbal - 1) * 2 as b, cast(3 as bigint) as c from supplier")
def lambda_forms(spark, d):
    """Curried functions, functions of functions, functions called where they stand."""
    return program(spark, d, """
plus = x -> y -> x + y
twice = f -> x -> f(x) * 2
less = x -> x - 1
three = () -> 3
load($supplier) |> select("s_suppkey", a: plus(10)(it.s_acctbal) + three(), b: less(it.s_acctbal) * 2, c: (x -> x)(3))
""")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(factorial(l_linenumber) as bigint) as f from lineitem")
def recursive_function(spark, d):
    return program(spark, d, """
fact = n -> match(n, <= 1: 1, _: n * fact(n - 1))
load($lineitem) |> select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", f: fact(it.l_linenumber))
""")


@query("select o_orderkey from orders where o_totalprice > 300000")
def result_patterns(spark, d):
    """A pipe that fails takes the other arm, one that doesn't its own."""
    return program(spark, d, """
broken = load($orders) |> filter(it.o_totalprice > it.o_orderstatus)
sound = load($orders) |> filter(it.o_totalprice > 300000) |> select("o_orderkey")
match(broken, Ok(t): t, Err(m): match(sound, Ok(t): t, Err(m): []))
""")


@query("select p_partkey, p_retailprice * 1.1 as gross, 'part ' || p_partkey || ': ' || p_brand as label from part")
def namespaces(spark, d):
    return program(spark, d, """
ns price {
  rate = 0.1
  gross = x -> x + x * rate
}
load($part) |> select("p_partkey", gross: price.gross(it.p_retailprice), label: "part {it.p_partkey}: {it.p_brand}")
""").withColumn("gross", F.round("gross", 6))


@query("select o_orderkey, length(regexp_replace(lower(o_orderpriority), '[^aeiou]', '', 'g')) as n from orders where o_totalprice >= 200000")
def use_python(spark, d):
    return program(spark, d, f"""
use "{HERE}/sample.py" as own
load($orders) |> own.big_orders(200000) |> select("o_orderkey", n: own.vowels(it.o_orderpriority))
""")


@query("""select p_partkey, round(p_retailprice * 1.25, 6) as t, case when p_size > 30 then 'large' when p_size > 10 then 'medium' else 'small' end as g from part""")
def use_program(spark, d):
    return program(spark, d, f"""
use "{HERE}/library.pipe" as lib
load($part) |> select("p_partkey", t: lib.taxed(it.p_retailprice), g: lib.grade(it.p_size))
""").withColumn("t", F.round("t", 6))


@query("select p_partkey, p_retailprice * 2 as twice from part where p_size > 20")
def program_file(spark, d):
    """A file with front matter, which finds its table by the environment."""
    os.environ["SLUICE_SAMPLE_TABLE"] = f"{d}/part.parquet"
    return as_frame(spark, run_file(spark, f"{HERE}/sample.pipe")).unordered()


# --- annotations and caches ---------------------------------------------------------------


@query("select o_orderkey, o_totalprice / 2 as half from orders where o_orderkey % 2 = 0")
def cached_step(spark, d):
    """The second run takes the step's rows from the store."""
    run = Interpreter(spark, LIBRARIES, cache_dir=scratch(spark))
    run.globals.set("orders", load(spark, d, "orders").frame)
    text = 'orders |> filter(it.o_orderkey % 2 == 0) |> select("o_orderkey", half: it.o_totalprice / 2) @cache'
    run.run(text)
    got = run.run(text)
    assert run.store.hits == 1
    return got.unordered()


@query("select c_custkey, c_acctbal + 1 as more from customer")
def progress_step(spark, d):
    return program(spark, d, 'load($customer) |> select("c_custkey", more: it.c_acctbal + 1) @progress quiet')


@query("select s_suppkey, s_suppkey + 1 as n from supplier")
def retried_calls(spark, d):
    """Every first call fails."""
    return program(spark, d, f"""
use "{HERE}/sample.py" as own
load($supplier) |> select("s_suppkey", n: own.shaky(it.s_suppkey)) @retry(2) @concurrent(3)
""")


# --- steps --------------------------------------------------------------------------------


@query("""select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) q where r <= 2""")
def collapse_lambda_take(spark, d):
    out = load(spark, d, "orders", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice").collapse(
        by="o_custkey", top='rows -> rows |> sort(by: "o_totalprice", dir: "desc") |> take(2)'
    ).df
    return out.select("o_custkey", F.explode("top").alias("r")).select("o_custkey", "r.o_orderkey")


@query("select c_custkey, r_name as region from customer, region where r_regionkey < 3")
def cross_table(spark, d):
    regions = load(spark, d, "region", "r_regionkey").filter("it.r_regionkey < 3").select("r_name")
    return load(spark, d, "customer").select("c_custkey").cross("r", regions).select("c_custkey", region="it.r.r_name").df


@query("""select o_orderpriority, idx, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as idx from orders) q
where idx between 2 and 40""")
def each_numbered(spark, d):
    t = load(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_orderpriority")
    return t.each("o_orderpriority", "|> slice(2, 40) |> mapi({idx: it.idx + 2, o_orderkey: it.val.o_orderkey})").df


def _window(expression: str, seen: int) -> str:
    w = "over (partition by event_type order by event_id rows between 4 preceding and current row)"
    return f"case when count(value) {w} = 5 then {expression.replace('$w', w)} end"


@query(f"""select event_id, {_window('min(value) $w', 5)} as low, {_window('max(value) $w', 5)} as high, round({_window('var_samp(value) $w', 5)}, 5) as spread,
{_window('median(value) $w', 5)} as middle, {_window('first_value(value) $w', 5)} as oldest, round({_window('stddev_samp(value) $w / 2.0', 5)}, 5) as error from events""")
def rolling_more(spark, d):
    names = {"low": "min", "high": "max", "spread": "var", "middle": "median", "oldest": "first", "error": "sem"}
    calls = {k: f'rolling(col.value, 5, "{v}", by: "event_type")' for k, v in names.items()}
    out = load(spark, d, "events", "event_id").add(**calls).select("event_id", *names).df
    return out.withColumns({c: F.round(c, 5) for c in ("spread", "error")})


# --- models and plots ---------------------------------------------------------------------


@query("select item_id, length(item_name) as n, cast(ascii(item_name) as double) as first from review_items")
def embed_by_provider(spark, d):
    ml.provide("embed", "sizes", lambda text, settings: [len(text), ord(text[0]), settings["dims"]])
    return program(spark, d, """
load($review_items) |> add(v: ml.embed(it.item_name, source: "sizes", dims: 3)) |> select("item_id", n: int(it.v[0]), first: it.v[1])
""")


@query("select item_id, upper(category) as said from review_items")
def llm_by_provider(spark, d):
    ml.provide("llm", "echo", lambda text, settings: '```json\n{"said": "' + text.upper() + '"}\n```')
    return program(spark, d, 'load($review_items) |> add(r: ml.llm(it.category, source: "echo", format: "json")) |> select("item_id", said: str(it.r.said))')


@query("""with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
d as (select a.vec_id, a.label as own, b.label as other, sum(list_distance(a.v, b.v)) as s, count(*) as n from e a, e b group by 1, 2, 3),
m as (select vec_id, max(case when own = other then n end) as k, sum(case when own = other then s / greatest(n - 1, 1) end) as a, min(case when own != other then s / n end) as b from d group by 1)
select round(avg(case when k = 1 then 0 else (b - a) / greatest(a, b) end), 6) as score from m""")
def silhouette_of_labels(spark, d):
    score = ml.silhouette(load(spark, d, "embeddings").select("vec_id", "label", "embedding").frame, "label", "embedding")
    return spark.createDataFrame([(round(score, 6),)], "score double")


@query("""with x as (select 'p_size' as field, cast(p_size as double) as v from part union all select 'p_retailprice', p_retailprice from part union all select 'p_partkey', cast(p_partkey as double) from part),
b as (select field, min(v) as lo, max(v) as hi from x group by 1)
select x.field, cast(least(floor((v - lo) / ((hi - lo) / 10)), 9) as integer) as bin, count(*) as n from x join b on x.field = b.field group by 1, 2""")
def plot_grid(spark, d):
    made = viz.step("grid", load(spark, d, "part").frame, {})
    return spark.createDataFrame([(c, b["bin"], b["n"]) for c, bins in made["data"].items() for b in bins if b["n"]], "field string, bin int, n bigint")


@query("select s_suppkey as x, s_acctbal as y, s_nationkey as color from supplier")
def plot_points(spark, d):
    made = viz.step("scatter", load(spark, d, "supplier").frame, {"x": "s_suppkey", "y": "s_acctbal", "color": "s_nationkey"})
    rows = made["data"] if isinstance(made, dict) else viz.points(load(spark, d, "supplier").frame, ["s_suppkey", "s_acctbal", "s_nationkey"])
    return spark.createDataFrame([(r["s_suppkey"], r["s_acctbal"], r["s_nationkey"]) for r in rows], "x bigint, y double, color int")


@query("select n_regionkey as x, sum(n_nationkey) as y from nation group by 1")
def plot_line(spark, d):
    t = load(spark, d, "nation").collapse(by="n_regionkey", y="sum(col.n_nationkey)")
    rows = viz.series(t.frame, "n_regionkey", "y")
    assert [r["n_regionkey"] for r in rows] == sorted(r["n_regionkey"] for r in rows)
    return spark.createDataFrame([(r["n_regionkey"], r["y"]) for r in rows], "x int, y bigint")


@query("select count(*) as n, cast(4 as bigint) as k, 0 as misplaced from embeddings")
def kmeans_nearest(spark, d):
    """Every row is labelled by the centre that is nearest to it."""
    got = load(spark, d, "embeddings").ml("kmeans", k=4, on="embedding", out="cluster")
    centres = [[float(x) for x in c] for c in got.artifacts["kmeans"]["model"].clusterCenters()]
    e = F.col("embedding").cast("array<double>")
    far = [F.aggregate(F.zip_with(e, F.lit(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) for c in centres]
    placed = got.df.select("cluster", F.array(*far).alias("far"))
    wrong = F.get("far", F.col("cluster")) > F.array_min("far") + 1e-9
    return placed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("k"), F.sum(wrong.cast("bigint")).alias("misplaced"))


@query("select n_nationkey, n_name from nation")
def printed_rows(spark, d):
    import ast
    import io

    out = io.StringIO()
    run = Interpreter(spark, LIBRARIES, out=out)
    run.run(f'load("{d}/nation.parquet") |> select("n_nationkey", "n_name") |> sort(by: "n_nationkey") |> print()')
    rows = [ast.literal_eval(line) for line in out.getvalue().splitlines()]
    assert [r["n_nationkey"] for r in rows] == sorted(r["n_nationkey"] for r in rows)
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")
