"""Functions over driver values: numbers, texts, lists and objects of a program."""

from __future__ import annotations

import json
import math
import os
import re
import statistics
import sys

from sluice.plans.frame import Err, Frame, Ok
from sluice.plans.values import PipeError


class Builtin:
    def __init__(self, name):
        self.name = name


def kind(v) -> str:
    return {type(None): "none", bool: "Bool", int: "Int", float: "Float", str: "Str", list: "List", dict: "Object", range: "Range", Frame: "Table"}.get(type(v), type(v).__name__)


def true(v) -> bool:
    if isinstance(v, (Err, Frame)):
        return True
    return bool(v.value if isinstance(v, Ok) else v)


def shown(v, none="None") -> str:
    if v is None:
        return none
    if isinstance(v, Err):
        return f"Err({v.msg})"
    if isinstance(v, Ok):
        return shown(v.value)
    if isinstance(v, range):
        return str(list(v))
    return str(v)


def echo(text, out=None):
    print(text, file=out or sys.stdout)


def plain(v):
    return v.value if isinstance(v, Ok) else list(v) if isinstance(v, range) else v


def listed(v) -> list:
    v = plain(v)
    if isinstance(v, (list, tuple)):
        return list(v)
    raise PipeError(f"expected a list, got {kind(v)}")


def _operands(op, a, b):
    raise PipeError(f"unsupported operands for {op}: {kind(a)} and {kind(b)}")


def binary(op, a, b):
    a, b = plain(a), plain(b)
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    try:
        if op == "+":
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op in "/%":
            if b == 0:
                raise PipeError("division by zero")
            return a / b if op == "/" else a % b
        return a > b if op == ">" else a < b if op == "<" else a >= b if op == ">=" else a <= b
    except TypeError:
        _operands(op, a, b)


def negative(v):
    if not isinstance(v, (int, float)):
        raise PipeError(f"unsupported operand for -: {kind(v)}")
    return -v


def _get(v, i):
    v = plain(v)
    try:
        return v[i]
    except (IndexError, KeyError, TypeError):
        raise PipeError(f"nothing at {i!r}") from None


def _slice(v, a, b):
    if a < 0 or b < 0:
        raise PipeError("slice takes no negative places")
    return listed(v)[a : b + 1]


def _set(v, i, x):
    out = listed(v)
    try:
        out[i] = x
    except IndexError:
        raise PipeError(f"nothing at {i!r}") from None
    return out


def _int(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    try:
        return int(v)
    except (ValueError, TypeError, OverflowError):
        raise PipeError(f"no whole number: {v!r}") from None


def _float(v):
    try:
        return float(v)
    except (ValueError, TypeError):
        raise PipeError(f"no number: {v!r}") from None


def _unique(v, by=None):
    seen, out = [], []
    for x in listed(v):
        key = x.get(by) if by else x
        if key not in seen:
            seen.append(key)
            out.append(x)
    return out


def _sort(v, by=None, dir="asc"):
    try:
        return sorted(listed(v), key=(lambda x: x.get(by)) if by else None, reverse=dir == "desc")
    except TypeError:
        raise PipeError("sort: values that have no order among them") from None


def _take(v, n):
    return listed(v)[:n]


def _join_all(v, *more):
    out = listed(v)
    for m in more:
        out = out + listed(m)
    return out


def _find(v, column, value):
    return next((r for r in listed(v) if r.get(column) == value), None)


def _len(v):
    if isinstance(v, str):
        raise PipeError("len of a text: use text.length")
    return len(listed(v))


CORE = {
    "get": _get, "slice": _slice, "set": _set, "int": _int, "float": _float, "str": shown, "unique": _unique, "sort": _sort, "take": _take,
    "concat": _join_all, "find": _find, "len": _len, "first": lambda v: next(iter(listed(v)), None),
    "last": lambda v: listed(v)[-1] if listed(v) else None, "map": None, "filter": None, "mapi": None, "reduce": None, "print": None,
    "halt": None, "save": None, "mean": lambda v: _library("math", "mean")(v), "sum": lambda v: _library("math", "sum")(v),
    "min": lambda v: _library("math", "min")(v), "max": lambda v: _library("math", "max")(v), "count": lambda v: _len(v),
}


def _need(test, text):
    if not test:
        raise PipeError(text)


def _log(x):
    _need(x > 0, "log of a number that isn't positive")
    return math.log(x)


def _sqrt(x):
    _need(x >= 0, "sqrt of a negative number")
    return math.sqrt(x)


def _full(name, fn, least=1):
    def f(v):
        v = listed(v)
        _need(len(v) >= least, f"{name} needs at least {least} values")
        return fn(v)

    return f


_MATH = {
    "log": _log, "sqrt": _sqrt, "pow": lambda a, b: a**b, "abs": abs, "floor": math.floor, "ceil": math.ceil, "round": round,
    "clamp": lambda x, lo, hi: max(lo, min(hi, x)), "mean": _full("mean", lambda v: sum(v) / len(v)), "sum": lambda v: sum(listed(v)),
    "min": _full("min", min), "max": _full("max", max), "median": _full("median", statistics.median), "std": _full("std", statistics.stdev, 2),
}


def _replace(s, old, new):
    _need(old != "", "replace of the empty text")
    return s.replace(old, new)


def _parse(s):
    try:
        return json.loads(s)
    except ValueError:
        raise PipeError("not JSON") from None


_TEXT = {
    "trim": str.strip, "lower": str.lower, "upper": str.upper, "replace": _replace, "split": lambda s, sep=None: s.split(sep),
    "join": lambda parts, sep: sep.join(shown(p) for p in parts), "contains": lambda s, x: x in s, "starts_with": lambda s, x: s.startswith(x),
    "ends_with": lambda s, x: s.endswith(x), "length": len, "match": lambda s, x: re.search(x, s) is not None,
    "slice": lambda s, a, b=None: s[a:b], "at": lambda s, i: s[i], "ord": ord, "char": chr, "chars": list, "parse": _parse,
}


def variable(name):
    value = os.environ.get(name)
    return Err(f"environment variable {name} is not set") if value is None else value


def _library(lib, short):
    table = {"math": _MATH, "text": _TEXT, "env": {"get": variable}}.get(lib, {})
    if short not in table:
        raise PipeError(f"{lib} has no function {short}")
    return table[short]


def call(lib, short, args, named):
    fn = _library(lib, short)
    try:
        return fn(*[plain(a) for a in args], **named)
    except PipeError as bad:
        return Err(str(bad), bad)
    except Exception as bad:
        return Err(f"{type(bad).__name__}: {bad}", bad)


def distance(a, b, metric="cosine"):
    if len(a) != len(b):
        raise PipeError("vectors of different length")
    if metric == "euclidean":
        return math.dist(a, b)
    dot = sum(x * y for x, y in zip(a, b))
    return 1 - dot / max(math.hypot(*a) * math.hypot(*b), 1e-10)
