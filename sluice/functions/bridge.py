"""Python functions for programs: decorators, and helpers over the rows of a table.

A function decorated with ``row`` is called per row and may be given a result
type; one decorated with ``whole`` takes and gives a DataFrame. In both, what goes
wrong becomes an error of the row or of the pipe. ``plain`` marks a function of driver
values. The helpers take a Table, a frame, a DataFrame or a list of objects and run
the function on one object per row, in Arrow batches.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.frame import Err, Frame, Ok, as_frame
from sluice.plans.interpreter import Table, TableFunction, row_function


def row(fn=None, *, kind=None, **settings):
    """As a decorator: a function of row values. ``kind``: the type of its result,
    else that of its annotation; ``retry`` and ``workers`` as of the annotations."""
    if fn is None:
        return functools.partial(row, kind=kind, **settings)
    return row_function(fn, kind, **settings)


def whole(fn) -> TableFunction:
    """As a decorator: a function from DataFrame to DataFrame."""
    return TableFunction(fn)


def plain(fn):
    """As a decorator: a function of driver values, whose exceptions become Err."""

    @functools.wraps(fn)
    def call(*args, **named):
        try:
            got = fn(*args, **named)
        except Exception as bad:
            return Err(str(bad), bad)
        return got if isinstance(got, (Ok, Err)) else Ok(got)

    return call


def _frame(spark, table) -> Frame:
    return table.frame if isinstance(table, Table) else as_frame(spark, table)




def _run(f: Frame, fn, kind: T.DataType):
    """A column with ``fn`` of each row's object."""

    def batch(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([fn(r) for r in rows.to_dict("records")], dtype=object)

    udf = F.pandas_udf(batch, kind)
    return udf(F.struct(*[F.col(f"`{c}`") for c in f.columns]))


def add_column(table, name: str, fn, kind: T.DataType | str = "string", spark=None) -> Frame:
    """``name`` added or replaced by ``fn(object)`` of type ``kind``."""
    f = _frame(spark, table)
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    return f.with_data(f.data.withColumn(name, _run(f, fn, kind)))


def filter_rows(table, fn, spark=None) -> Frame:
    """The rows for which ``fn(object)`` is true."""
    f = _frame(spark, table)
    return f.with_data(f.data.filter(_run(f, lambda r: bool(fn(r)), T.BooleanType())))


def map_rows(table, fn, schema: str, spark=None) -> Frame:
    """A table of the objects ``fn(object)``, with the fields of ``schema``."""
    f = _frame(spark, table)
    kind = T._parse_datatype_string(schema)
    names = [x.name for x in kind.fields]

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{n: got.get(n) for n in names} for got in map(fn, rows.to_dict("records"))], columns=names)

    batch.__annotations__ = {"rows": pd.DataFrame, "return": pd.DataFrame}
    made = F.pandas_udf(batch, kind)(F.struct(*[F.col(f"`{c}`") for c in f.columns]))
    data = f.data.select(made.alias("_made"), *[F.col(c) for c in f.secret])
    return f.with_data(data.select("_made.*", *[F.col(c) for c in f.secret]), errors=None, artifacts={})
