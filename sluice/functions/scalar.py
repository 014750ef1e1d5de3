"""math and text functions over columns, each with its error condition.

Every entry takes compiled values and gives a compiled value. What the functions
reject (a negative root, an empty list's mean) becomes a row error.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.values import (
    BOOL, DOUBLE, LONG, STRING, PipeError, Val, as_text, errs, failing, is_int, is_list, is_number, is_text, number,
    when_err,
)


def _real(v: Val, name: str):
    if not is_number(v):
        raise PipeError(f"{name} needs a number, not {v.kind.simpleString()}")
    return v.col.cast("double"), errs(v.err, when_err(v.col.isNull(), f"{name} of none"))


def _text(v: Val, name: str):
    if not is_text(v):
        raise PipeError(f"{name} needs text, not {v.kind.simpleString()}")
    return v.col, errs(v.err, when_err(v.col.isNull(), f"{name} of none") if v.nullable else None)


def _list(v: Val, name: str, least: int = 1):
    if not is_list(v):
        raise PipeError(f"{name} needs a list, not {v.kind.simpleString()}")
    short = when_err(F.coalesce(F.size(v.col), F.lit(0)) < least, f"{name} needs at least {least} values")
    return v.col.cast("array<double>"), errs(v.err, short)


def log(v):
    x, e = _real(v, "log")
    return Val(F.when(x > 0, F.log(x)), DOUBLE, errs(e, when_err(x <= 0, "log of a number that isn't positive")))


def sqrt(v):
    x, e = _real(v, "sqrt")
    return Val(F.when(x >= 0, F.sqrt(x)), DOUBLE, errs(e, when_err(x < 0, "sqrt of a negative number")))


def power(v, w):
    (x, e), (y, f) = _real(v, "pow"), _real(w, "pow")
    if is_int(v) and is_int(w):
        got = F.pow(x, y)
        exact = F.when((y >= 0) & (F.abs(got) < 2.0**53), F.round(got))
        return Val(F.coalesce(exact, got), DOUBLE, errs(e, f))
    return Val(F.pow(x, y), DOUBLE, errs(e, f))


def absolute(v):
    x, e = _real(v, "abs")
    return Val(F.abs(number(v)), LONG if is_int(v) else DOUBLE, e)


def _to_long(name, make):
    def f(v):
        x, e = _real(v, name)
        got = make(x)
        return Val(F.when(F.abs(got) < 9.2e18, got).try_cast("bigint"), LONG, errs(e, when_err(F.isnan(x), f"{name} of nan")))

    return f


def clamp(v, lo, hi):
    (x, e), (a, f), (b, g) = _real(v, "clamp"), _real(lo, "clamp"), _real(hi, "clamp")
    if is_int(v) and is_int(lo) and is_int(hi):
        return Val(F.greatest(number(lo), F.least(number(hi), number(v))), LONG, errs(e, f, g))
    return Val(F.greatest(a, F.least(b, x)), DOUBLE, errs(e, f, g))


def _fold(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(v):
    a, e = _list(v, "mean")
    return Val(F.try_divide(_fold(a), F.size(a).cast("double")), DOUBLE, e)


def total(v):
    a, e = _list(v, "sum", 0)
    whole = isinstance(v.kind.elementType, (T.IntegerType, T.LongType))
    return Val(_fold(a).cast("bigint") if whole else _fold(a), LONG if whole else DOUBLE, e)


def least(v):
    _, e = _list(v, "min")
    return Val(F.array_min(v.col), v.kind.elementType, e)


def greatest(v):
    _, e = _list(v, "max")
    return Val(F.array_max(v.col), v.kind.elementType, e)


def median(v):
    a, e = _list(v, "median")
    s, n = F.array_sort(a), F.size(a)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return Val((low + high) / 2, DOUBLE, e)


def std(v):
    a, e = _list(v, "std", 2)
    m = F.try_divide(_fold(a), F.size(a).cast("double"))
    squares = F.aggregate(a, F.struct(F.lit(0.0).alias("s")), lambda s, x: F.struct((s["s"] + (x - m) * (x - m)).alias("s")))
    return Val(F.sqrt(F.try_divide(squares["s"], (F.size(a) - 1).cast("double"))), DOUBLE, e)


MATH = {
    "log": log, "sqrt": sqrt, "pow": power, "abs": absolute, "floor": _to_long("floor", F.floor), "ceil": _to_long("ceil", F.ceil),
    "round": _to_long("round", F.rint), "clamp": clamp, "mean": mean, "sum": total, "min": least, "max": greatest,
    "median": median, "std": std,
}


# --- text ---------------------------------------------------------------------------------

_SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"


def trim(v):
    x, e = _text(v, "trim")
    return Val(F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", ""), STRING, e)


def lower(v):
    x, e = _text(v, "lower")
    return Val(F.lower(x), STRING, e)


def upper(v):
    x, e = _text(v, "upper")
    return Val(F.upper(x), STRING, e)


def replace(v, old, new):
    (x, e), (o, f), (n, g) = _text(v, "replace"), _text(old, "replace"), _text(new, "replace")
    return Val(F.replace(x, o, n), STRING, errs(e, f, g, when_err(o == "", "replace of the empty text")))


def split(v, sep=None):
    x, e = _text(v, "split")
    if sep is None:
        parts = F.split(trim(v).col, f"{_SPACE}+")
        return Val(F.filter(parts, lambda p: p != ""), T.ArrayType(STRING), e)
    s, f = _text(sep, "split")
    return Val(F.split(x, F.concat(F.lit("\\Q"), s, F.lit("\\E")), F.lit(-1)), T.ArrayType(STRING), errs(e, f, when_err(s == "", "split at the empty text")))


def join(v, sep):
    if not is_list(v):
        raise PipeError("join needs a list")
    s, f = _text(sep, "join")
    inner = v.kind.elementType
    texts = F.transform(v.col, lambda x: as_text(Val(x, inner)).col)
    joined = F.aggregate(texts, F.lit(None).cast("string"), lambda a, x: F.coalesce(F.concat(a, s, x), x), lambda a: F.coalesce(a, F.lit("")))
    return Val(joined, STRING, errs(v.err, f))


def _test(name, fn):
    def f(v, w):
        (x, e), (y, g) = _text(v, name), _text(w, name)
        return Val(fn(x, y), BOOL, errs(e, g))

    return f


def length(v):
    x, e = _text(v, "length")
    return Val(F.char_length(x).cast("bigint"), LONG, e)


def cut(v, start, end=None):
    x, e = _text(v, "slice")
    n = F.char_length(x).cast("bigint")
    place = lambda p: F.greatest(F.lit(0), F.least(n, F.when(p < 0, p + n).otherwise(p)))
    a = place(number(start))
    b = n if end is None else place(number(end))
    return Val(F.substr(x, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int")), STRING, errs(e, start.err, None if end is None else end.err))


def at(v, i):
    x, e = _text(v, "at")
    n, p = F.char_length(x).cast("bigint"), number(i)
    out = when_err((p >= n) | (p < -n), "place outside the text")
    return Val(F.substr(x, F.when(p < 0, p + n + 1).otherwise(p + 1).cast("int"), F.lit(1)), STRING, errs(e, i.err, out))


def code(v):
    x, e = _text(v, "ord")
    return Val(F.ascii(x).cast("bigint"), LONG, errs(e, when_err(F.char_length(x) != 1, "ord needs one character")))


def char(v):
    """The character of a code point; halves of surrogate pairs are none."""
    x, e = _real(v, "char")
    none = (x < 0) | (x >= 0x110000) | ((x >= 0xD800) & (x < 0xE000))
    code = F.when(~none, number(v).cast("bigint"))
    return Val(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), STRING, errs(e, when_err(none, "no such character")))


def chars(v):
    x, e = _text(v, "chars")
    return Val(F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, "")), T.ArrayType(STRING), e)


def parse(v):
    x, e = _text(v, "parse")
    got = F.try_parse_json(x)
    return Val(got, T.VariantType(), errs(e, when_err(got.isNull(), "not JSON")))


TEXT = {
    "trim": trim, "lower": lower, "upper": upper, "replace": replace, "split": split, "join": join,
    "contains": _test("contains", lambda x, y: F.contains(x, y)), "starts_with": _test("starts_with", lambda x, y: F.startswith(x, y)),
    "ends_with": _test("ends_with", lambda x, y: F.endswith(x, y)), "length": length, "match": _test("match", lambda x, y: F.rlike(x, y)),
    "slice": cut, "at": at, "ord": code, "char": char, "chars": chars, "parse": parse,
}


# --- vectors ------------------------------------------------------------------------------


def dist(v: Val, w: Val, metric: str = "cosine") -> Val:
    """Cosine distance 1 - dot / max(norms, 1e-10), or euclidean."""
    if not (is_list(v) and is_list(w)):
        return failing("dist needs two lists", DOUBLE)
    a, b = v.col.cast("array<double>"), w.col.cast("array<double>")
    e = errs(v.err, w.err, when_err(v.col.isNull() | w.col.isNull(), "dist of none"), when_err(F.size(a) != F.size(b), "vectors of different length"))
    if metric == "euclidean":
        return Val(F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))), DOUBLE, e)
    if metric != "cosine":
        raise PipeError(f"unknown metric {metric}")
    dot = _fold(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(_fold(F.transform(a, lambda x: x * x))) * F.sqrt(_fold(F.transform(b, lambda x: x * x)))
    return Val(1 - dot / F.greatest(norms, F.lit(1e-10)), DOUBLE, e)
