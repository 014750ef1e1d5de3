"""Queries and SQL of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.clusters import describe_groups, mixture_clusters, similarity_groups, unit_vectors
from sluice.llm.leaks import leaked
from sluice.llm.packing import pack_texts
from sluice.llm.percentiles import percentiles, summarize
from sluice.llm.spam import LEAST_CHARS, stuffed
from sluice.llm.topn import top_n
from sluice.runtime import materialize


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_service_percentiles(spark, d):
    return percentiles(table(spark, d, "logs"), ["service"], "latency_ms")


def p3_service_day_percentiles(spark, d):
    logs = table(spark, d, "logs").withColumn("day", F.to_date("log_ts"))
    return percentiles(logs, ["service", "day"], "latency_ms")


def p3_from_days(spark, d):
    """The services' percentiles put together from the days' summaries, which are
    stored: the passes of the bisection read them and not the logs."""
    days = summarize(table(spark, d, "logs").withColumn("day", F.to_date("log_ts")), ["service", "day"], "latency_ms")
    return percentiles(materialize(days), ["service"], "value", weight="n")


def p6_found(spark, d):
    top = top_n(table(spark, d, "sales"), "region", "revenue", "sale_id", 5)
    return top.select(F.col("grp").alias("region"), F.col("id").alias("sale_id"))


def _groups(spark, d):
    return similarity_groups(unit_vectors(table(spark, d, "catalog_items"), "item_id", "embedding"))


def p7_found(spark, d):
    return _groups(spark, d).select(F.col("id").alias("item_id"), F.col("head").alias("head_id"))


def p7_groups(spark, d):
    """Each group with its size and most typical items."""
    return describe_groups(_groups(spark, d)).withColumnRenamed("head", "head_id")


def p7_clusters(spark, d):
    """The mixture's components with their sizes and most typical items."""
    return mixture_clusters(unit_vectors(table(spark, d, "catalog_items"), "item_id", "embedding"))


def p8_packing(spark, d):
    packed = pack_texts(table(spark, d, "documents"), table(spark, d, "containers"))
    return packed.withColumnRenamed("id", "doc_id")


def p8_fill(spark, d):
    """How full the containers of each kind are."""
    each = p8_packing(spark, d).groupBy("container_kind", "capacity", "container_id").agg(F.sum("tokens").alias("t"))
    return each.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("tokens"), (F.sum("t") / F.sum("capacity")).alias("fill")
    )


def p8_invariants(spark, d):
    """Per kind: texts packed; containers over their capacity; texts whose pieces are
    not the whole text in order; texts split although they fit. The last three are 0."""
    packed = p8_packing(spark, d)
    kinds = ["container_kind", "capacity"]
    full = packed.groupBy(*kinds, "container_id").agg(F.sum("tokens").alias("t")).groupBy(*kinds).agg(
        F.sum((F.col("t") > F.col("capacity")).cast("bigint")).alias("overfull")
    )
    whole = packed.groupBy(*kinds, "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.sum("tokens").alias("t"), F.max(F.col("start_token") + F.col("tokens")).alias("end")
    )
    sound = whole.groupBy(*kinds).agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(((F.col("n") != F.col("last") + 1) | (F.col("t") != F.col("end"))).cast("bigint")).alias("torn"),
        F.sum(((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).cast("bigint")).alias("split"),
    )
    return full.join(sound, kinds)


def p9_found(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    got = leaked(docs, items, "doc_id", "text", "eval_id", "passage", share=0.4)
    return got.select(F.col("doc").alias("doc_id"), F.col("item").alias("eval_id"))


def p10_found(spark, d):
    """Texts that lie far from their language's centre in the direction of spam."""
    judged = stuffed(table(spark, d, "documents"), "doc_id", "text", "lang")
    return judged.filter((F.col("chars") >= LEAST_CHARS) & F.col("flagged")).select(F.col("id").alias("doc_id"))


def _percentile_sql(keys: str, where: str) -> str:
    ps = ", ".join(f"max(case when r = (n * {p} + 99) // 100 then latency_ms end) as p{p}" for p in (50, 90, 95, 99))
    return f"""
with x as (select service, cast(log_ts as date) as day, latency_ms from logs where service is not null and latency_ms is not null {where}),
r as (select {keys}, latency_ms, row_number() over (partition by {keys} order by latency_ms) as r,
             count(*) over (partition by {keys}) as n from x)
select {keys}, max(n) as n, {ps} from r group by {keys}"""


QUERIES = {f.__name__: f for f in (p3_service_percentiles, p3_service_day_percentiles, p3_from_days, p6_found, p7_found, p7_groups, p7_clusters, p8_packing, p8_fill, p8_invariants, p9_found, p10_found)}

SQL = {
    "p3_service_percentiles": _percentile_sql("service", ""),
    "p3_service_day_percentiles": _percentile_sql("service, day", "and log_ts is not null"),
    "p3_from_days": _percentile_sql("service", ""),  # readings without a day count too: the services' percentiles
    "p8_invariants": """select container_kind, cast(capacity_tokens as bigint) as capacity, (select count(*) from documents where text is not null) as texts,
        0 as overfull, 0 as torn, 0 as split from containers where exists (select 1 from documents where text is not null)""",
    "p7_found": """with v as (select item_id, cast(embedding as double[]) as e from catalog_items where len(embedding) = 64
          and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x))) and list_bool_or(list_transform(embedding, lambda x: x != 0))),
        n as (select a.item_id, list_sort(list(b.item_id)) as near from v a join v b on list_cosine_similarity(a.e, b.e) >= 0.86 group by 1),
        g as (select near from n group by 1 having count(*) = len(near) and len(near) > 1)
        select item_id, near[1] as head_id from n join g using (near)""",
    "p6_found": """select region, sale_id from (select region, sale_id, row_number() over
        (partition by region order by revenue desc, sale_id) as r from sales where region is not null and revenue is not null) q where r <= 5""",
}
