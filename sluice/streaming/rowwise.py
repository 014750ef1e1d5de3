"""Row-wise steps over streaming DataFrames.

filter, add, select, drop, rename, map, cross and flatten need no order and no
other rows, so the same lowering holds for a stream. Rows that fail leave in a
second stream, to be written by its own query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sluice.lang import ast
from sluice.lang.parser import parse_expression
from sluice.plans import compiler as C
from sluice.plans import steps as S
from sluice.plans.frame import Err, Frame
from sluice.plans.interpreter import LIBRARIES, Interpreter
from sluice.plans.values import PipeError

STREAMABLE = ("filter", "add", "select", "drop", "rename", "map", "cross", "flatten")


def stream_steps(stream: DataFrame, pipe: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows, errors or None) of a pipe such as ``|> filter(it.a > 1)``."""
    steps = parse_expression(f"each(by: none, {pipe})").args[-1].steps
    run = Interpreter(stream.sparkSession, LIBRARIES)
    f = Frame(stream, ordered=False)
    for s in steps:
        call = s.call if isinstance(s.call, ast.Call) else ast.Call(s.call)
        title = C.dotted(call.fn)
        if title not in STREAMABLE or S._has_window(call):
            raise PipeError(f"{title} needs more than one row, which a stream doesn't give")
        got = run.step_call(title, call, f, run.globals, ())
        if isinstance(got, Err):
            raise PipeError(got.msg)
        f = got
    return f.unordered(), f.errors
