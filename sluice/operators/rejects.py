"""Strict loading of delimited records, with the rejects set apart and explained.

Strict load plus anti-join: every raw record keeps its offset, only conforming
records are loaded as typed rows, the loaded offsets are subtracted from the raw
offsets, and what remains is diagnosed. Reading is done by built-in expressions:
a record is cut at its quote marks, delimiters outside of quotes become field
ends, and every step is linear in the record's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as no value, compared in lower case.
NULL_TOKENS = ("na", "n/a", "null", "none", "nan")

BLANKS = " \t\n\x0b\f\r\u00a0\u3000"

_END, _ESC = "\x01", "\x02"


@dataclass(frozen=True)
class Field:
    """A typed field: ``pattern`` that its text matches, of digits with or without
    a point; bounds of its value, whole numbers of at most 18 digits."""

    name: str
    type: str
    pattern: str
    least: int
    greatest: int


PEOPLE = (
    Field("age", "int", r"^[0-9]+$", 0, 120),
    Field("income", "bigint", r"^[0-9]+$", 0, 100_000_000),
    Field("score", "double", r"^([0-9]+(\.[0-9]*)?|\.[0-9]+)$", 0, 1),
)


def split_record(line: Column, delim: Column) -> Column:
    """Fields as written, quotes kept: cut at each ``delim`` outside of quotes."""
    safe = F.replace(F.replace(line, F.lit(_ESC), F.lit(_ESC + "b")), F.lit(_END), F.lit(_ESC + "a"))
    pieces = F.split(safe, F.lit('"'), -1)
    marked = F.transform(
        pieces, lambda p, i: F.when(i % 2 == 0, F.replace(p, delim, F.lit(_END))).otherwise(p)
    )
    fields = F.split(F.array_join(marked, '"'), F.lit(_END), -1)
    return F.transform(
        fields, lambda f: F.replace(F.replace(f, F.lit(_ESC + "a"), F.lit(_END)), F.lit(_ESC + "b"), F.lit(_ESC))
    )


def _inner(f: Column) -> Column:
    return F.substr(f, F.lit(2), F.char_length(f) - 2)


def _is_quoted(f: Column) -> Column:
    return f.startswith('"') & f.endswith('"') & (F.char_length(f) >= 2) & ~F.replace(_inner(f), F.lit('""'), F.lit("")).contains('"')


def _sound(f: Column) -> Column:
    """A well quoted field, or one without quote marks and line breaks."""
    return _is_quoted(f) | ~(f.contains('"') | f.contains("\n") | f.contains("\r"))


def _value(f: Column) -> Column:
    plain = F.when(_is_quoted(f), F.replace(_inner(f), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.btrim(plain, F.lit(BLANKS))


def _absent(v: Column) -> Column:
    return (v == "") | F.lower(v).isin(*NULL_TOKENS)


def _readable(v: Column, f: Field) -> Column:
    """The text is a number within the bounds, however many digits it has: the
    whole part is compared as a number, of the fraction it counts only whether
    it is nil. A whole part of more than 18 digits is above any bound."""
    whole = F.regexp_extract(v, r"^0*([0-9]*)", 1)
    number = F.when(F.char_length(whole) <= 18, F.concat(F.lit("0"), whole)).try_cast("bigint")
    more = v.rlike(r"\.[0-9]*[1-9]")
    within = (number >= f.least) & ((number < f.greatest) | ((number == f.greatest) & ~more))
    return v.rlike(f.pattern) & F.coalesce(within, F.lit(False))


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame
    rejected: DataFrame
    rejects: DataFrame


def _parsed(raw: DataFrame, feeds: DataFrame, line: str, feed: str) -> DataFrame:
    """raw + ``_delim, _n, _names, _fields``; feeds are joined without any hint,
    so their size decides how."""
    spec = feeds.select(
        F.col("feed").alias("_feed"), F.col("delim").alias("_delim"), F.col("n_fields").alias("_n"),
        F.split(F.col("header"), F.concat(F.lit("\\Q"), F.col("delim"), F.lit("\\E"))).alias("_names"),
    ).dropDuplicates(["_feed"])
    cut = split_record(F.col(line), F.col("_delim"))
    return raw.join(spec, raw[feed] == F.col("_feed"), "left").withColumn("_fields", _once(cut))


def _once(value: Column) -> Column:
    """``value`` worked out a single time per row: filters and projections that
    use the result are not pushed below a generator, so its expression is not
    copied into each of them."""
    return F.explode(F.array(value))


def _text(name: str) -> Column:
    at = F.array_position(F.col("_names"), name).cast("int")
    return F.when(at > 0, _value(F.get(F.col("_fields"), at - 1)))


def load_strict(
    raw: DataFrame,
    feeds: DataFrame,
    offset: str = "raw_id",
    line: str = "raw_line",
    feed: str = "feed",
    texts: tuple[str, ...] = ("name", "region", "remark"),
    fields: tuple[Field, ...] = PEOPLE,
) -> Loaded:
    """Typed rows of the conforming records, and the other records with a reason.

    ``rows``: offset, the text fields (null where absent) and the typed fields.
    ``rejected``: the offsets of the other records, found without moving a line.
    ``rejects``: offset, feed, line and ``reason``, the first that holds of
    ``missing record``, ``unknown feed``, ``backslash before quote``,
    ``unclosed quote``, ``broken quoting``, ``too few fields``,
    ``too many fields``, ``line break outside quotes``, ``unreadable X``,
    ``X out of range``. A record with a null or unknown feed, a null line or a
    null offset is a reject. Repeated records count each, by their offsets.
    Extra columns of ``raw`` are ignored. Empty input: both results empty.
    """
    raw = raw.select(F.col(offset).alias("offset"), F.col(feed).alias("feed"), F.col(line).alias("line"))
    read = _parsed(raw, feeds, "line", "feed")
    conforming = read.filter(
        F.col("offset").isNotNull()
        & F.col("_n").isNotNull()
        & (F.size("_fields") == F.col("_n"))
        & F.forall("_fields", _sound)
        & ~F.col("line").contains('\\"')
    )
    names = [*texts, *(f.name for f in fields)]
    conforming = conforming.select("offset", "feed", _once(F.struct(*[_text(t).alias(t) for t in names])).alias("t")).select(
        "offset", "feed", "t.*"
    )
    for f in fields:
        v = F.col(f.name)
        conforming = conforming.filter(v.isNull() | _absent(v) | _readable(v, f))
    rows = conforming.select(
        "offset", "feed",
        *[F.when(~_absent(F.col(t)), F.col(t)).alias(t) for t in texts],
        *[F.when(~_absent(F.col(f.name)), F.col(f.name)).try_cast(f.type).alias(f.name) for f in fields],
    )
    rejected = raw.select("offset").join(conforming.select("offset"), "offset", "left_anti")
    lost = rejected.select(F.col("offset").alias("_lost"))
    left = raw.join(lost, F.col("offset").eqNullSafe(F.col("_lost")), "left_semi")
    return Loaded(rows, rejected, diagnose(left, feeds, fields))


def diagnose(left: DataFrame, feeds: DataFrame, fields: tuple[Field, ...] = PEOPLE) -> DataFrame:
    read = _parsed(left, feeds, "line", "feed")
    marks = F.size(F.split(F.col("line"), F.lit('"'), -1)) - 1
    quoted = F.exists("_fields", lambda f: f.contains('"') & ~_is_quoted(f))
    reason = (
        F.when(F.col("line").isNull() | F.col("offset").isNull(), F.lit("missing record"))
        .when(F.col("_n").isNull(), F.lit("unknown feed"))
        .when(F.col("line").contains('\\"'), F.lit("backslash before quote"))
        .when(marks % 2 == 1, F.lit("unclosed quote"))
        .when(quoted, F.lit("broken quoting"))
        .when(F.size("_fields") < F.col("_n"), F.lit("too few fields"))
        .when(F.size("_fields") > F.col("_n"), F.lit("too many fields"))
        .when(~F.forall("_fields", _sound), F.lit("line break outside quotes"))
    )
    read = read.withColumn("_t", _once(F.struct(*[_text(f.name).alias(f.name) for f in fields])))
    for f in fields:
        v = F.col(f"_t.{f.name}")
        reason = reason.when(~_absent(v) & ~v.rlike(f.pattern), F.lit(f"unreadable {f.name}"))
        reason = reason.when(~_absent(v) & ~_readable(v, f), F.lit(f"{f.name} out of range"))
    return read.select("offset", "feed", "line", reason.otherwise(F.lit("not loaded")).alias("reason"))
