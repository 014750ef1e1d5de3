"""Queries of the pipe operators, each with its SQL.

Every query runs over its whole tables. Order-sensitive steps name the key that
orders their rows, in the query and in its SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import ml, viz
from sluice.plans.interpreter import LIBRARIES, Interpreter, Table, row_function, table
from sluice.plans.frame import as_frame
from sluice.runtime import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


def load(spark, d, name, *order) -> Table:
    return table(spark.read.parquet(f"{d}/{name}.parquet"), order_by=list(order) or None)


def program(spark, d, text: str) -> DataFrame:
    """Run a program of the language; ``$T`` stands for the path of table T."""
    import re

    run = Interpreter(spark, LIBRARIES)
    got = run.run(re.sub(r"\$(\w+)", lambda m: f'"{d}/{m.group(1)}.parquet"', text))
    return as_frame(spark, got).unordered()


@query("""select l_returnflag, cast(sum(cast(net as decimal(28,6))) as double) as total, avg(net) as avg_net, count(*) as n
from (select l_returnflag, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem where l_quantity > 10) q group by 1""")
def flagship_net_by_flag(spark, d):
    t = load(spark, d, "lineitem").filter("it.l_quantity > 10")
    net = t.df.withColumn("net", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).select("l_returnflag", "net")
    out = Table(net).collapse(by="l_returnflag", total="sum(col.net)", avg_net="mean(col.net)", n="count()").sort(by="total", dir="desc")
    return out.df.withColumns({"total": F.round("total", 2), "avg_net": F.round("avg_net", 4)})


SQL["flagship_net_by_flag"] = """select l_returnflag, round(sum(net), 2) as total, round(avg(net), 4) as avg_net, count(*) as n
from (select l_returnflag, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem where l_quantity > 10) q group by 1"""


@query("""select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as total, count(*) as n from lineitem
where l_quantity > 10 group by 1""")
def program_net_by_flag(spark, d):
    return program(spark, d, """
load($lineitem)
  |> filter(it.l_quantity > 10)
  |> add(net: it.l_extendedprice * (1 - it.l_discount))
  |> collapse(by: "l_returnflag", total: sum(col.net), n: count())
  |> sort(by: "total", dir: "desc")
""").withColumn("total", F.round("total", 2))


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000 and (o_orderstatus = 'F' or o_orderpriority = '1-URGENT')")
def filter_and_or(spark, d):
    return load(spark, d, "orders").filter(
        'it.o_totalprice > 200000 and (it.o_orderstatus == "F" or it.o_orderpriority == "1-URGENT")'
    ).select("o_orderkey", "o_totalprice").df


@query("select log_id, service from logs where status is not null and log_level is not distinct from 'ERROR'")
def filter_none(spark, d):
    return load(spark, d, "logs").filter('it.status != none and it.log_level == "ERROR"').select("log_id", "service").df


@query("select c_custkey as id, upper(c_mktsegment) || '/' || c_nationkey as label from customer")
def map_object(spark, d):
    return load(spark, d, "customer").map('{id: it.c_custkey, label: text.upper(it.c_mktsegment) + "/" + str(it.c_nationkey)}').df


@query("select row_number() over (order by o_orderkey) - 1 as idx, o_custkey as cust from orders")
def mapi_index(spark, d):
    return load(spark, d, "orders", "o_orderkey").mapi("{idx: it.idx, cust: it.val.o_custkey}").df


@query("select c_custkey, c_acctbal * 2 as twice, c_acctbal + 100.0 as more, c_nationkey + 1 as next_key from customer")
def add_multi(spark, d):
    return load(spark, d, "customer").add(twice="it.c_acctbal * 2", more="it.c_acctbal + 100.0", next_key="it.c_nationkey + 1").select(
        "c_custkey", "twice", "more", "next_key"
    ).df


@query("""select c_custkey, case when c_acctbal > 5000 then 'high' when c_acctbal > 0 then 'medium' else 'low' end as tier,
case c_mktsegment when 'BUILDING' then 1 else 0 end as building from customer""")
def add_match_tier(spark, d):
    return load(spark, d, "customer").add(
        tier='match(it.c_acctbal, > 5000: "high", > 0: "medium", _: "low")', building='match(it.c_mktsegment, "BUILDING": 1, _: 0)'
    ).select("c_custkey", "tier", "building").df


@query("select p_partkey, p_name || ' (' || p_brand || ', size ' || p_size || ')' as label from part")
def add_interpolation(spark, d):
    return load(spark, d, "part").add(label='"{it.p_name} ({it.p_brand}, size {it.p_size})"').select("p_partkey", "label").df


@query("select o_orderkey, o_totalprice / 1000 as thousands, o_orderkey % 7 as week from orders")
def select_computed(spark, d):
    return load(spark, d, "orders").select("o_orderkey", thousands="it.o_totalprice / 1000", week="it.o_orderkey % 7").df


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def drop(spark, d):
    return load(spark, d, "orders").drop("o_orderdate", "o_orderpriority", "no_such_field").df


@query("select o_orderkey, o_custkey as customer from orders")
def rename(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_custkey").rename(o_custkey="customer").df


@query("select c_custkey, {'c_custkey': c_custkey, 'c_nationkey': c_nationkey}.c_nationkey + 1 as n from customer")
def object_spread(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_nationkey").map("{...it, n: it.c_nationkey + 1}").drop("c_nationkey").df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def sort_take_topk(spark, d):
    return load(spark, d, "orders", "o_orderkey").sort(by="o_totalprice", dir="desc").take(25).select("o_orderkey", "o_totalprice").df


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as r from events) q where r = 1")
def unique_by(spark, d):
    return load(spark, d, "events", "event_id").unique(by="user_id").select("event_id", "user_id", "event_type").df


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def unique_rows(spark, d):
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").unique().df


@query("select c_name as name, c_custkey as key from customer union all select p_name, p_partkey from part")
def concat_tables(spark, d):
    a = load(spark, d, "customer").select(name="it.c_name", key="it.c_custkey")
    return a.concat(load(spark, d, "part").select(name="it.p_name", key="it.p_partkey")).df


@query("select o_orderkey, m as model from orders, (values ('a'), ('b'), ('c')) v(m)")
def cross_values(spark, d):
    return load(spark, d, "orders").select("o_orderkey").cross("model", ["a", "b", "c"]).df


@query("select item_id, unnest(string_split(item_name, ' ')) as value from review_items")
def flatten_scalars(spark, d):
    return load(spark, d, "review_items").select("item_id", words='text.split(it.item_name, " ")').flatten("words").df


@query("""select s_suppkey, unnest([s_nationkey, s_nationkey + 1]) as k, unnest(['a', 'b']) as kind from supplier""")
def flatten_objects(spark, d):
    return load(spark, d, "supplier").select(
        "s_suppkey", parts='[{k: it.s_nationkey, kind: "a"}, {k: it.s_nationkey + 1, kind: "b"}]'
    ).flatten("parts").df


@query("select o_orderkey, c_custkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey")
def join_inner(spark, d):
    right = load(spark, d, "customer", "c_custkey").select("c_custkey", "c_name").add(o_custkey="it.c_custkey")
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(right, on="o_custkey").select(
        "o_orderkey", "c_custkey", "c_name", "o_totalprice"
    ).df


@query("""select c_custkey, o_orderkey as last_order from customer join (select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1) q
on c_custkey = o_custkey""")
def join_last_wins(spark, d):
    right = load(spark, d, "orders", "o_orderkey").select(c_custkey="it.o_custkey", last_order="it.o_orderkey")
    return load(spark, d, "customer").select("c_custkey").join(right, on="c_custkey").df


@query("select o_custkey, o_orderkey, c_name as o_orderstatus from orders join customer on o_custkey = c_custkey")
def join_collision(spark, d):
    right = load(spark, d, "customer", "c_custkey").select(o_custkey="it.c_custkey", o_orderstatus="it.c_name")
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus").join(right, on="o_custkey").df


@query("""select l.log_id, l.status, m.sale_id from logs l join (select status, max(log_id) as sale_id from logs group by 1) m
on l.status is not distinct from m.status""")
def join_null_key(spark, d):
    right = load(spark, d, "logs", "log_id").select("status", sale_id="it.log_id")
    return load(spark, d, "logs").select("log_id", "status").join(right, on="status").df


@query("select o_orderkey, c_name as customer from orders join customer on o_custkey = c_custkey")
def find_lookup(spark, d):
    run = Interpreter(spark, LIBRARIES)
    run.globals.set("customers", load(spark, d, "customer", "c_custkey").frame)
    t = Table(load(spark, d, "orders").frame, run)
    return t.add(customer='find(customers, "c_custkey", it.o_custkey).c_name').select("o_orderkey", "customer").df


@query("select count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as average, min(o_totalprice) as low, max(o_totalprice) as high from orders")
def collapse_global(spark, d):
    return load(spark, d, "orders").collapse(
        n="count()", total="sum(col.o_totalprice)", average="mean(col.o_totalprice)", low="min(col.o_totalprice)", high="max(col.o_totalprice)"
    ).df.withColumns({"total": F.round("total", 2), "average": F.round("average", 4)})


@query("""select region, count(*) as n, coalesce(sum(revenue), 0) as total, min(revenue) as low, max(units) as most, round(avg(revenue), 4) as average
from sales where region is not null group by 1""")
def collapse_by(spark, d):
    return load(spark, d, "sales").collapse(
        by="region", n="count()", total="sum(col.revenue)", low="min(col.revenue)", most="max(col.units)", average="mean(it.revenue)"
    ).df.withColumn("average", F.round("average", 4))


@query("select o_orderstatus, o_orderpriority, count(*) as n, 5 as five from orders group by 1, 2")
def collapse_two_keys(spark, d):
    return load(spark, d, "orders").collapse(by=["o_orderstatus", "o_orderpriority"], n="count()", five="5").df


@query("select l_returnflag, round(sum(l_quantity), 2) as qty from lineitem group by 1")
def collapse_sorted(spark, d):
    return load(spark, d, "lineitem").collapse(by="l_returnflag", qty="sum(col.l_quantity)").sort(by="qty", dir="desc").df.withColumn("qty", F.round("qty", 2))


@query("""select label, pos, round(avg(x), 5) as m from (select label, unnest(generate_series(0, len(embedding) - 1)) as pos,
cast(unnest(embedding) as double) as x from embeddings) q group by 1, 2""")
def collapse_vector_mean(spark, d):
    out = load(spark, d, "embeddings").collapse(by="label", m="mean(col.embedding)").df
    return out.select("label", F.posexplode("m").alias("pos", "m")).withColumns({"m": F.round("m", 5), "pos": F.col("pos").cast("bigint")})


@query("""select label, pos, min(x) as lo, max(x) as hi from (select label, unnest(generate_series(0, len(embedding) - 1)) as pos,
cast(unnest(embedding) as double) as x from embeddings) q group by 1, 2""")
def collapse_vector_minmax(spark, d):
    out = load(spark, d, "embeddings").collapse(by="label", lo="min(col.embedding)", hi="max(col.embedding)").df
    return out.select("label", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "z")).select("label", F.col("pos").cast("bigint").alias("pos"), "z.lo", "z.hi")


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r
from orders) q where r = 1""")
def collapse_lambda_top(spark, d):
    out = load(spark, d, "orders", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice").collapse(
        by="o_custkey", top='rows -> rows |> sort(by: "o_totalprice", dir: "desc") |> get(0)'
    ).df
    return out.select("o_custkey", "top.o_orderkey", "top.o_totalprice")


@query("select o_custkey, string_agg(o_orderpriority, ',' order by o_orderkey) as names from orders group by 1")
def collapse_lambda_names(spark, d):
    out = load(spark, d, "orders", "o_orderkey").collapse(by="o_custkey", names="rows -> rows |> map(it.o_orderpriority)").df
    return out.select("o_custkey", F.array_join("names", ",").alias("names"))


@query("""select c_custkey, round(avg(c_acctbal) over (partition by c_nationkey), 6) as nation_mean,
count(*) over (partition by c_nationkey) as nation_n from customer""")
def broadcast_group_mean(spark, d):
    return load(spark, d, "customer").add(nation_mean='mean(col.c_acctbal, by: "c_nationkey")', nation_n='count(by: "c_nationkey")').select(
        "c_custkey", "nation_mean", "nation_n"
    ).df.withColumn("nation_mean", F.round("nation_mean", 6))


@query("select p_partkey, round(p_retailprice - (select avg(p_retailprice) from part), 6) as off from part")
def broadcast_global(spark, d):
    return load(spark, d, "part").add(off="it.p_retailprice - mean(col.p_retailprice)").select("p_partkey", "off").df.withColumn("off", F.round("off", 6))


@query("select o_orderkey from (select o_orderkey, o_totalprice, avg(o_totalprice) over (partition by o_orderpriority) as m from orders) q where o_totalprice > m")
def above_group_avg(spark, d):
    return load(spark, d, "orders").add(above='it.o_totalprice > mean(col.o_totalprice, by: "o_orderpriority")').filter("it.above").select("o_orderkey").df


@query("select p_partkey, rank() over (order by p_retailprice desc) as r from part")
def rank_global(spark, d):
    return load(spark, d, "part").add(r='rank(col.p_retailprice, dir: "desc")').select("p_partkey", "r").df


@query("select o_orderkey, rank() over (partition by o_orderpriority order by o_totalprice) as r from orders")
def rank_by(spark, d):
    return load(spark, d, "orders").add(r='rank(col.o_totalprice, by: "o_orderpriority")').select("o_orderkey", "r").df


@query("""select o_orderkey, o_custkey, o_totalprice from (select *, rank() over (partition by o_custkey order by o_totalprice desc) as r from orders) q
where r <= 3""")
def each_topn(spark, d):
    t = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return t.each("o_custkey", '|> add(r: rank(col.o_totalprice, dir: "desc")) |> filter(it.r <= 3) |> drop("r")').df


def _rolling(fn, n=3, by=True):
    parts = "partition by event_type " if by else ""
    w = f"over ({parts}order by event_id rows between {n - 1} preceding and current row)"
    agg = {"mean": "avg(value)", "sum": "sum(value)", "count": "cast(count(value) as double)", "std": "stddev_samp(value)"}[fn]
    seen = "count(*)" if fn == "count" else "count(value)"
    return f"select event_id, round(case when {seen} {w} = {n} then {agg.replace(')', f') {w}', 1) if fn != 'count' else f'cast(count(value) {w} as double)'} end, 5) as r from events"


def _roll(spark, d, fn, by=True):
    call = f"rolling(col.value, 3, {fn}" + (', by: "event_type")' if by else ")")
    return load(spark, d, "events", "event_id").add(r=call).select("event_id", "r").df.withColumn("r", F.round("r", 5))


@query(_rolling("mean"))
def rolling_mean(spark, d):
    return _roll(spark, d, "mean")


@query(_rolling("sum"))
def rolling_sum_by(spark, d):
    return _roll(spark, d, "sum")


@query(_rolling("count"))
def rolling_count(spark, d):
    return _roll(spark, d, "count")


@query(_rolling("std"))
def rolling_std(spark, d):
    return _roll(spark, d, '"std"')


@query("select o_orderpriority, o_orderstatus, count(*) as n, round(max(o_totalprice), 2) as top from orders group by 1, 2")
def each_collapse(spark, d):
    return load(spark, d, "orders").each("o_orderpriority", '|> collapse(by: "o_orderstatus", n: count(), top: max(col.o_totalprice))').df


@query(_rolling("mean").replace("event_id, round", "event_id, event_type, round"))
def each_rolling(spark, d):
    t = load(spark, d, "events", "event_id").select("event_id", "event_type", "value")
    return t.each("event_type", "|> add(r: rolling(col.value, 3, mean))").drop("value").df.withColumn("r", F.round("r", 5))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) q where r <= 2")
def each_lambda_take(spark, d):
    t = load(spark, d, "orders", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")
    return t.each("o_custkey", 'g -> g |> sort(by: "o_totalprice", dir: "desc") |> take(2)').drop("o_totalprice").df


@query("select cast(sum(c_custkey) as bigint) as total from customer")
def reduce_fold(spark, d):
    got = load(spark, d, "customer", "c_custkey").reduce(0, _lambda("(acc, x) -> acc + x.c_custkey"))
    return spark.createDataFrame([(got,)], "total bigint")


def _lambda(text):
    from sluice.lang.parser import parse_expression

    return parse_expression(text)


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, 'add(q)' as step from lineitem where l_tax = 0")
def errors_div_zero(spark, d):
    t = load(spark, d, "lineitem").add(q="it.l_extendedprice / it.l_tax")
    return t.errors.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("_step").alias("step"))


@query("select person_id from people where try_cast(region as bigint) is null and region is not null")
def errors_cast(spark, d):
    return load(spark, d, "people").select("person_id", n="int(it.region)").errors.select("person_id")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when l_tax = 0 then -1.0 else l_extendedprice / l_tax end, 4) as q from lineitem")
def recover_literal(spark, d):
    t = load(spark, d, "lineitem").add(q="it.l_extendedprice / it.l_tax").recover(q="-1.0")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q").df.withColumn("q", F.round("q", 4))


@query("select log_id, cast(coalesce(latency_ms, 0) as bigint) * 2 as twice from logs")
def recover_expr(spark, d):
    return load(spark, d, "logs").add(twice="it.latency_ms * 2").recover(twice="match(it.latency_ms, == none: 0, _: it.latency_ms * 2)").select("log_id", "twice").df


@query("""select sale_id, revenue - 7 * cast(floor(revenue / 7.0) as bigint) as m, revenue - (-7) * cast(floor(revenue / -7.0) as bigint) as neg
from sales where revenue is not null""")
def mod_python(spark, d):
    return load(spark, d, "sales").select("sale_id", m="it.revenue % 7", neg="it.revenue % -7").df


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round_even(l_quantity / 2, 0) as bigint) as r from lineitem")
def round_bankers(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r="math.round(it.l_quantity / 2)").df


@query("""select o_orderkey, cast(trunc(o_totalprice) as bigint) as whole, cast(o_custkey as varchar) as txt, cast(o_custkey as double) as real
from orders""")
def casts(spark, d):
    return load(spark, d, "orders").select("o_orderkey", whole="int(it.o_totalprice)", txt="str(it.o_custkey)", real="float(it.o_custkey)").df


def _texts(name, expressions: dict, sql: str):
    def run(spark, d):
        return load(spark, d, "documents").filter("it.text != none").select("doc_id", **expressions).df

    run.__name__ = name
    query(f"select doc_id, {sql} from documents where text is not null")(run)


_texts("text_case", {"lo": "text.lower(it.text)", "up": 'text.upper(text.replace(it.text, "ß", "ss"))'}, "lower(text) as lo, upper(replace(text, 'ß', 'ss')) as up")
_texts("text_trim", {"t": 'text.trim("  " + it.source + "  ")'}, "source as t")
_texts("text_replace", {"r": 'text.replace(it.text, "the", "THE")'}, "replace(text, 'the', 'THE') as r")
_texts("text_split", {"n": 'len(text.split(it.text, " "))'}, "cast(len(string_split(text, ' ')) as bigint) as n")
_texts("text_join", {"j": 'text.join(text.split(it.text, " "), "_")'}, "replace(text, ' ', '_') as j")
_texts(
    "text_tests",
    {"c": 'text.contains(it.text, "the")', "s": 'text.starts_with(it.text, "The")', "e": 'text.ends_with(it.text, ".")'},
    "contains(text, 'the') as c, starts_with(text, 'The') as s, suffix(text, '.') as e",
)
_texts("text_length", {"n": "text.length(it.text)"}, "cast(length(text) as bigint) as n")
_texts("text_match", {"m": 'text.match(it.text, "[0-9]+ [a-z]+z")'}, "regexp_matches(text, '[0-9]+ [a-z]+z') as m")
_texts(
    "text_slice", {"a": "text.slice(it.text, 2, 9)", "b": "text.slice(it.text, -5)", "c": "text.at(it.source, 1)", "o": "text.ord(text.at(it.source, 0))"},
    "substring(text, 3, 7) as a, right(text, 5) as b, substring(source, 2, 1) as c, cast(unicode(source) as bigint) as o",
)
_texts("text_chars", {"n": "len(text.chars(it.text))", "h": "text.char(65 + it.doc_id % 20000)"}, "cast(length(text) as bigint) as n, chr(cast(65 + doc_id % 20000 as integer)) as h")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def text_parse(spark, d):
    return load(spark, d, "events").select("event_id", k="int(text.parse(it.props).k)").df


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(ln(l_quantity), 6) as l, round(sqrt(l_quantity), 6) as s,
cast(power(l_quantity, 2) as double) as p, cast(floor(l_extendedprice) as bigint) as f, cast(ceil(l_extendedprice) as bigint) as c,
abs(0 - l_quantity) as a, greatest(5.0, least(20.0, l_quantity)) as k from lineitem""")
def math_scalars(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", l="math.log(it.l_quantity)", s="math.sqrt(it.l_quantity)", p="math.pow(it.l_quantity, 2)",
        f="math.floor(it.l_extendedprice)", c="math.ceil(it.l_extendedprice)", a="math.abs(0 - it.l_quantity)", k="math.clamp(it.l_quantity, 5.0, 20.0)",
    ).df.withColumns({"l": F.round("l", 6), "s": F.round("s", 6)})


@query("""select vec_id, round(list_avg(e), 6) as mean, round(list_median(e), 6) as median, round(list_stddev_samp(e), 6) as std, list_min(e) as lo,
list_max(e) as hi, round(list_sum(e), 5) as total from (select vec_id, cast(embedding as double[]) as e from embeddings) q""")
def math_lists(spark, d):
    t = load(spark, d, "embeddings")
    t = Table(t.df.withColumn("e", F.col("embedding").cast("array<double>")))
    out = t.select("vec_id", mean="math.mean(it.e)", median="math.median(it.e)", std="math.std(it.e)", lo="math.min(it.e)", hi="math.max(it.e)", total="math.sum(it.e)").df
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")} | {"total": F.round("total", 5)})


_PAIRS = """(select a.vec_id, cast(a.embedding as double[]) as e, cast(b.embedding as double[]) as f
from embeddings a join (select label, embedding from (select *, row_number() over (partition by label order by vec_id) as r from embeddings) z where r = 1) b
on a.label = b.label)"""


def _with_first(spark, d) -> Table:
    run = Interpreter(spark, LIBRARIES)
    run.globals.set("vectors", load(spark, d, "embeddings", "vec_id").frame)
    return Table(load(spark, d, "embeddings").frame, run)


@query(f"select vec_id, round(list_cosine_distance(e, f), 5) as dist from {_PAIRS} q")
def dist_cosine(spark, d):
    t = _with_first(spark, d).add(dist='ml.dist(it.embedding, find(vectors, "label", it.label).embedding)')
    return t.select("vec_id", "dist").df.withColumn("dist", F.round("dist", 5) + 0.0)


@query(f"select vec_id, round(list_distance(e, f), 5) as dist from {_PAIRS} q")
def dist_euclidean(spark, d):
    t = _with_first(spark, d).add(dist='ml.dist(it.embedding, find(vectors, "label", it.label).embedding, metric: "euclidean")')
    return t.select("vec_id", "dist").df.withColumn("dist", F.round("dist", 5))


@query("""with m as (select label, list(x order by pos) as c from (select label, pos, avg(x) as x from (select label,
unnest(generate_series(0, len(embedding) - 1)) as pos, cast(unnest(embedding) as double) as x from embeddings) q group by 1, 2) r group by 1)
select vec_id, round(list_distance(cast(embedding as double[]), c), 5) as dist from embeddings e join m on e.label = m.label""")
def centroid_distance(spark, d):
    t = load(spark, d, "embeddings")
    centres = t.collapse(by="label", centre="mean(col.embedding)")
    return t.join(centres, on="label").add(dist='ml.dist(it.embedding, it.centre, metric: "euclidean")').select("vec_id", "dist").df.withColumn("dist", F.round("dist", 5))


@query("select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem")
def ols_fit(spark, d):
    got = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice").ml("ols", on="l_extendedprice").artifacts["ols"]
    c = got["coefficients"]
    return spark.createDataFrame([(round(c["l_quantity"], 4), round(c["intercept"], 3), round(got["r2"], 6))], "slope double, intercept double, r2 double")


@query("select round(corr(l_quantity, l_extendedprice), 6) as qe, round(corr(l_quantity, l_tax), 6) as qt, round(corr(l_discount, l_tax), 6) as dt from lineitem")
def corr_matrix(spark, d):
    m = viz.correlations(load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax").frame)
    q = m["l_quantity"]
    return spark.createDataFrame([(round(q["l_extendedprice"], 6), round(q["l_tax"], 6), round(m["l_discount"]["l_tax"], 6))], "qe double, qt double, dt double")


@query("""with b as (select min(p_retailprice) as lo, max(p_retailprice) as hi from part),
h as (select cast(least(floor((p_retailprice - lo) / ((hi - lo) / 10)), 9) as integer) as bin from part, b)
select bin, count(*) as n from h group by 1""")
def hist_bins(spark, d):
    rows = viz.histogram(load(spark, d, "part").frame, "p_retailprice", 10)
    return spark.createDataFrame([(r["bin"], r["n"]) for r in rows if r["n"]], "bin int, n bigint")


@query("select min(o_orderkey) as first_key, max(o_orderkey) as last_key, count(*) as n, (select o_orderkey from orders order by o_orderkey limit 1 offset 10) as tenth from orders")
def positions(spark, d):
    t = load(spark, d, "orders", "o_orderkey")
    row = (t.first()["o_orderkey"], t.last()["o_orderkey"], t.len(), t.get(10)["o_orderkey"])
    return spark.createDataFrame([row], "first_key bigint, last_key bigint, n bigint, tenth bigint")


@query("select o_orderkey from orders order by o_orderkey limit 16 offset 5")
def slice_rows(spark, d):
    return load(spark, d, "orders", "o_orderkey").slice(5, 20).select("o_orderkey").df


@query()
def kmeans_labels(spark, d):
    return load(spark, d, "embeddings").ml("kmeans", k=4, on="embedding", out="cluster").select("vec_id", "cluster").df


@query()
def silhouette(spark, d):
    f = load(spark, d, "embeddings").ml("kmeans", k=3, on="embedding", out="cluster").frame
    return spark.createDataFrame([(ml.silhouette(f, "cluster", "embedding"),)], "score double")


@query("select doc_id, n_chars * 2 as twice from documents where n_chars is not null")
def concurrent_udf(spark, d):
    run = Interpreter(spark, LIBRARIES)
    run.globals.set("twice", row_function(lambda n: n * 2, int))
    t = Table(load(spark, d, "documents").select("doc_id", "n_chars").frame, run)
    return t._call("add", twice="twice(it.n_chars)", notes=(("concurrent", (4,)), ("retry", (2,)))).select("doc_id", "twice").df


@query("select doc_id, length(text) as n from documents where text is not null")
def row_cache_rerun(spark, d):
    run = Interpreter(spark, LIBRARIES, cache_dir=scratch(spark))
    run.globals.set("measure", row_function(len, int))
    t = Table(load(spark, d, "documents").select("doc_id", "text").filter("it.text != none").frame, run)
    step = lambda: t._call("add", n="measure(it.text)", notes=(("row_cache", ()),))
    step()
    return step().select("doc_id", "n").df
