"""Queries of the training-data operators that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.event_features import event_counts, event_features
from sluice.operators.rejects import load_strict
from sluice.operators.spikes import flag_implausible
from sluice.operators.trailing import trailing_totals


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def level_name():
    """The spellings of log levels in use."""
    up = F.upper(F.trim("log_level"))
    return F.when(up == "ERR", "ERROR").when(up == "WARNING", "WARN").otherwise(up)


def _loaded(spark, d):
    return load_strict(table(spark, d, "people_raw"), table(spark, d, "people_feeds"))


def p1_found(spark, d):
    return _loaded(spark, d).rejected.select(F.col("offset").alias("raw_id"))


def p1_people(spark, d):
    return _loaded(spark, d).rows.select(
        F.col("offset").alias("raw_id"), F.col("name").alias("person_name"), "age", "income", "region", "score"
    )


def p1_reasons(spark, d):
    return _loaded(spark, d).rejects.groupBy("feed", "reason").agg(F.count(F.lit(1)).alias("n"))


def _flags(spark, d):
    flags = flag_implausible(table(spark, d, "logs"), "service", "log_ts", "log_id", "latency_ms")
    return flags.filter("impossible or stuck or spike")  # without those that only surprise


def p2_found(spark, d):
    return _flags(spark, d).select(F.col("id").alias("log_id"))


def p2_flags(spark, d):
    return _flags(spark, d).select(
        F.col("id").alias("log_id"), F.col("source").alias("service"), "impossible", "stuck", "spike"
    )


def p4_trailing(spark, d):
    return trailing_totals(table(spark, d, "logs"), "service", "log_ts", "latency_ms").withColumnRenamed("entity", "service")


def p5_features(spark, d):
    logs = table(spark, d, "logs")
    return event_features(logs, "service", [level_name(), F.col("status")], "log_ts", "latency_ms").withColumnRenamed("entity", "service")


def p5_features_long(spark, d):
    logs = table(spark, d, "logs")
    return event_counts(logs, "service", [level_name(), F.col("status")], "log_ts", "latency_ms").withColumnRenamed("entity", "service")


#: A list of types for a table whose columns are the same for any logs.
LISTED = [f"{level}_{status}" for level in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "none") for status in (200, 201, 204, 304, 400, 404, 429, 500, 503, "none")]


def p5_features_listed(spark, d):
    logs = table(spark, d, "logs")
    got = event_features(logs, "service", [level_name(), F.col("status")], "log_ts", "latency_ms", kinds=LISTED)
    return got.withColumnRenamed("entity", "service")


QUERIES = {f.__name__: f for f in (p1_found, p1_people, p1_reasons, p2_found, p2_flags, p4_trailing, p5_features, p5_features_long, p5_features_listed)}

_P2 = """
with r as (select log_id, service, log_ts, latency_ms as v from logs where service is not null and latency_ms is not null),
med as (select service, median(v) as m from r where v > 0 group by service),
dist as (select r.service, abs(ln(r.v) - ln(m)) as d, log_id from r join med on r.service = med.service where v > 0),
mad as (select service, median(d) as s from dist group by service),
t as (select *, row_number() over (partition by service order by log_ts, log_id)
             - row_number() over (partition by service, v order by log_ts, log_id) as island from r where log_ts is not null),
runs as (select log_id, count(*) over (partition by service, v, island) as n from t)
select r.log_id, r.service, (v <= 0 or v > 86400000) as impossible, coalesce(n >= 10, false) as stuck,
       coalesce(d > 10 * s, false) as spike
from r left join runs on r.log_id = runs.log_id left join dist on r.log_id = dist.log_id left join mad on r.service = mad.service
where v <= 0 or v > 86400000 or coalesce(n >= 10, false) or coalesce(d > 10 * s, false)
"""

SQL = {
    "p2_found": f"select log_id from ({_P2}) q",
    "p2_flags": _P2,
    "p4_trailing": """
with daily as (select service, cast(log_ts as date) as day, count(*) as calls, count(latency_ms) as readings,
                      coalesce(sum(latency_ms), 0) as total
               from logs where service is not null and log_ts is not null group by 1, 2),
span as (select min(day) as a, max(day) as b from daily),
cal as (select s.service, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as date) as day
        from (select distinct service from daily) s, span),
dense as (select cal.service, cal.day, coalesce(calls, 0) as calls, coalesce(readings, 0) as readings, coalesce(total, 0) as total
          from cal left join daily on cal.service = daily.service and cal.day = daily.day),
w as (select service, day, calls, total,
        sum(calls) over w7 as calls_7, sum(total) over w7 as total_7, sum(readings) over w7 as r7,
        sum(calls) over w30 as calls_30, sum(total) over w30 as total_30, sum(readings) over w30 as r30
      from dense
      window w7 as (partition by service order by day rows between 6 preceding and current row),
             w30 as (partition by service order by day rows between 29 preceding and current row))
select service, day, calls, cast(total as bigint) as total,
  cast(calls_7 as bigint) as calls_7, cast(total_7 as bigint) as total_7,
  cast(total_7 as double) / nullif(r7, 0) as mean_7, cast(total_7 as double) / 7.0 as daily_7,
  cast(calls_30 as bigint) as calls_30, cast(total_30 as bigint) as total_30,
  cast(total_30 as double) / nullif(r30, 0) as mean_30, cast(total_30 as double) / 30.0 as daily_30
from w""",
}


def _people_sql() -> str:
    """All records with their fields by a regular expression per feed: where the
    expression does not match the whole record, it is no record of the feed."""
    feeds = {
        "crm_export": (",", ["name", "age", "income", "region", "score"]),
        "branch_upload": (";", ["name", "age", "income", "region", "score"]),
        "partner_feed": ("\\|", ["region", "name", "score", "age", "income"]),
        "legacy_dump": ("\t", ["name", "region", "age", "income", "score", "remark"]),
    }
    parts = []
    for feed, (delim, names) in feeds.items():
        field = f'("(?:[^"]|"")*"|[^"\r\n{delim}]*)'
        whole = delim.join([field] * len(names))
        picks = []
        for i, n in enumerate(names, 1):
            raw = f"regexp_extract(raw_line, '^{whole}$', {i})"
            bare = f"case when starts_with({raw}, '\"') then replace(substring({raw}, 2, length({raw}) - 2), '\"\"', '\"') else {raw} end"
            clean = f"regexp_replace({bare}, '^\\s+|\\s+$', '', 'g')"
            picks.append(f"case when {clean} = '' or lower({clean}) in ('na', 'n/a', 'null', 'none', 'nan') then null else {clean} end as f_{n}")
        parts.append(
            f"select raw_id, regexp_full_match(raw_line, '{whole}') and not contains(raw_line, '\\\"') as fits, "
            + ", ".join(sorted(p for p in picks if not p.endswith("f_remark")))
            + f" from people_raw where feed = '{feed}'"
        )
    order = ["age", "income", "name", "region", "score"]
    shaped = [f"select raw_id, fits, {', '.join('f_' + n for n in order)} from ({p}) x{i}" for i, p in enumerate(parts)]
    return f"""
with r as ({' union all '.join(shaped)}),
v as (select *, fits
  and (f_age is null or (regexp_full_match(f_age, '[0-9]+') and try_cast(f_age as double) between 0 and 120))
  and (f_income is null or (regexp_full_match(f_income, '[0-9]+') and try_cast(f_income as double) between 0 and 100000000))
  and (f_score is null or (regexp_full_match(f_score, '[0-9]+(\\.[0-9]*)?|\\.[0-9]+') and try_cast(f_score as double) between 0 and 1)) as valid
  from r)"""


SQL["p1_found"] = _people_sql() + """
select raw_id from people_raw where raw_id not in (select raw_id from v where valid)"""
SQL["p1_people"] = _people_sql() + """
select raw_id, f_name as person_name, cast(f_age as integer) as age, cast(f_income as bigint) as income, f_region as region,
cast(f_score as double) as score from v where valid"""
def _reasons_sql() -> str:
    """Each record cut at the delimiters that lie outside of quotes, and the first
    of the reasons that holds."""
    quoted = lambda x: f"""({x} like '"%' and {x} like '%"' and length({x}) >= 2 and not contains(replace(substring({x}, 2, length({x}) - 2), '""', ''), '"'))"""
    bare = f"""list_transform(fs, lambda x: regexp_replace(case when {quoted('x')} then replace(substring(x, 2, length(x) - 2), '""', '"') else x end,
      '^[\\s\u00a0\u3000]+|[\\s\u00a0\u3000]+$', '', 'g'))"""
    whens = ""
    for name, pattern, top in (("age", "[0-9]+", 120), ("income", "[0-9]+", 100_000_000), ("score", "[0-9]+(\\.[0-9]*)?|\\.[0-9]+", 1)):
        v = f"vs[list_position(names, '{name}')]"
        some = f"{v} != '' and lower({v}) not in ('na', 'n/a', 'null', 'none', 'nan')"
        whens += f"when {some} and not regexp_full_match({v}, '{pattern}') then 'unreadable {name}' "
        whens += f"when {some} and cast({v} as double) > {top} then '{name} out of range' "
    return f"""
with f as (select feed as known, delim, n_fields, string_split(header, delim) as names from people_feeds),
r as (select feed, known, n_fields, names, raw_line as line,
        string_split(array_to_string(list_transform(string_split(raw_line, '"'), lambda p, i: case when i % 2 = 1 then replace(p, delim, chr(1)) else p end), '"'), chr(1)) as fs
      from people_raw left join f on feed = known),
v as (select *, {bare} as vs, list_transform(fs, lambda x: {quoted('x')}) as qs, list_transform(fs, lambda x: contains(x, '"')) as ms,
        list_transform(fs, lambda x: contains(x, chr(10)) or contains(x, chr(13))) as bs from r),
w as (select feed, case when line is null then 'missing record' when known is null then 'unknown feed' when contains(line, '\\"') then 'backslash before quote'
        when (length(line) - length(replace(line, '"', ''))) % 2 = 1 then 'unclosed quote'
        when list_bool_or(list_transform(list_zip(ms, qs), lambda z: z[1] and not z[2])) then 'broken quoting'
        when len(fs) < n_fields then 'too few fields' when len(fs) > n_fields then 'too many fields'
        when list_bool_or(list_transform(list_zip(bs, qs), lambda z: z[1] and not z[2])) then 'line break outside quotes' {whens} end as reason from v)
select feed, reason, count(*) as n from w where reason is not null group by 1, 2"""


SQL["p1_reasons"] = _reasons_sql()
_KINDS = """(select service, coalesce(case upper(trim(log_level)) when 'ERR' then 'ERROR' when 'WARNING' then 'WARN' else upper(trim(log_level)) end, 'none')
  || '_' || coalesce(cast(status as varchar), 'none') as kind, log_ts, latency_ms,
  (select epoch_us(max(log_ts)) from logs where service is not null) as until from logs where service is not null)"""
SQL["p5_features_long"] = f"""
select service, kind, count(*) as n, cast(coalesce(sum(latency_ms), 0) as bigint) as total, (max(until) - epoch_us(max(log_ts))) / 1000000.0 as age_s
from {_KINDS} k group by 1, 2"""
_PICKS = "".join(
    f""", count(*) filter ({when}) as "{k}_n", cast(coalesce(sum(latency_ms) filter ({when}), 0) as bigint) as "{k}_total",
    (max(until) - epoch_us(max(log_ts) filter ({when}))) / 1000000.0 as "{k}_age_s\""""
    for k, when in [*((k, f"kind = '{k}'") for k in LISTED), ("other", "kind not in (" + ", ".join(f"'{k}'" for k in LISTED) + ")")]
)
SQL["p5_features_listed"] = f"select service{_PICKS} from {_KINDS} k group by 1"
