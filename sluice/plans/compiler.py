"""Row expressions to columns.

A scope binds ``it`` to the row of a frame (or to an element of a list), names
to driver values, and knows what a step may use: window functions inside add and
select, lookups in other tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.scalar import MATH, TEXT, dist
from sluice.lang import ast
from sluice.plans import values as V
from sluice.plans.frame import Frame, ranked, single
from sluice.plans.values import PipeError, Val

DEPTH = 64  # how deep user functions are inlined into a row expression
AGGREGATES = ("sum", "mean", "count", "min", "max")


@dataclass
class Closure:
    params: tuple
    body: object
    env: object
    name: str = ""


@dataclass
class Macro:
    """A declaration that mentions ``it``: worked out where it is used."""

    body: object
    env: object
    notes: tuple = ()


@dataclass
class RowFunction:
    """A Python function over plain values, called per row through Arrow."""

    fn: Callable
    kind: T.DataType | None = None
    retry: int = 0
    workers: int = 1


@dataclass
class Scope:
    frame: Frame
    env: object  # driver names: .get(name) -> value, raises KeyError
    row: dict | None = None  # names of it's fields; None: it is self.it
    it: Val | None = None
    local: dict = field(default_factory=dict)  # names bound to Vals
    depth: int = 0
    windows: bool = True
    lookups: dict = field(default_factory=dict)  # canonical find -> (struct column name, kind)
    notes: dict = field(default_factory=dict)

    def inner(self, **changes) -> Scope:
        base = dict(self.__dict__)
        base.update(changes)
        return Scope(**base)


def row_scope(frame: Frame, env, **more) -> Scope:
    nullable = {f.name: f.nullable for f in frame.data.schema.fields}
    row = {n: Val(F.col(f"`{n}`"), k, nullable=nullable[n]) for n, k in frame.kinds().items()}
    return Scope(frame, env, row=row, **more)


def mentions_it(node) -> bool:
    return "it" in ast.free_names(node)


def compile_node(node, s: Scope) -> Val:
    return _COMPILE[type(node)](node, s)


def _lit(n, s):
    return V.literal(n.value)


def _text(n, s):
    parts = [V.literal(p) if isinstance(p, str) else V.as_text(compile_node(p, s), none="") for p in n.parts]
    return Val(F.concat(*[p.col for p in parts]), V.STRING, V.errs(*[p.err for p in parts]), False)


def _name(n, s):
    if n.name == "it":
        return _whole_row(s)
    if n.name in s.local:
        return s.local[n.name]
    try:
        value = s.env.get(n.name)
    except KeyError:
        raise PipeError(f"undefined name: {n.name}") from None
    return _driver_value(value, s)


def _driver_value(value, s):
    if isinstance(value, Val):
        return value
    if isinstance(value, Macro):
        return compile_node(value.body, s.inner(env=value.env, notes={**s.notes, **notes_of(value.notes, s)}))
    return V.literal(value)


def notes_of(notes, s) -> dict:
    out = {}
    for name, args, named in notes:
        out[name] = [a.value for a in args if isinstance(a, ast.Lit)] + [v.value for _, v in named if isinstance(v, ast.Lit)]
    return out


def _whole_row(s):
    if s.row is None:
        return s.it
    return V.struct(s.row)


def _list(n, s):
    items = []
    for i in n.items:
        if isinstance(i, ast.Spread):
            got = compile_node(i.value, s)
            if not V.is_list(got):
                raise PipeError("spread of something that isn't a list")
            items.append(got)
        else:
            items.append(V.array([compile_node(i, s)]))
    if not items:
        return V.array([])
    out = items[0]
    for more in items[1:]:
        kind = T.ArrayType(V.joint_kind([out.kind.elementType, more.kind.elementType]))
        out = Val(F.concat(out.col.cast(kind), more.col.cast(kind)), kind, V.errs(out.err, more.err), False)
    return out


def object_fields(n, s) -> dict[str, Val]:
    fields: dict[str, Val] = {}
    for e in n.entries:
        if isinstance(e, ast.Spread):
            if isinstance(e.value, ast.Name) and e.value.name == "it" and s.row is not None:
                fields |= s.row
                continue
            got = compile_node(e.value, s)
            if not isinstance(got.kind, T.StructType):
                raise PipeError("spread of something that isn't an object")
            fields |= {f.name: Val(got.col[f.name], f.dataType, got.err) for f in got.kind.fields}
        elif e[1] is not None:
            fields[e[0]] = compile_node(e[1], s)
        else:
            try:
                fields[e[0]] = _name(ast.Name(e[0]), s)
            except PipeError:
                fields[e[0]] = V.literal(True)
    return fields


def _object(n, s):
    return V.struct(object_fields(n, s))


def _range(n, s):
    a, b = compile_node(n.low, s), compile_node(n.high, s)
    x, y = V.number(a), V.number(b)
    got = F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
    return Val(got, T.ArrayType(V.LONG), V.errs(a.err, b.err))


def _get(n, s):
    if isinstance(n.value, ast.Name):
        if n.value.name == "it" and s.row is not None:
            return _field(s, n.field)
        if n.value.name == "col" and "col" not in s.local:
            return _field(s, n.field)
        if n.value.name not in s.local:
            got = _driver(n, s)
            if got is not None:
                return got
    got = compile_node(n.value, s)
    return _member(got, n.field)


def _field(s, name):
    if name not in s.row:
        raise PipeError(f"no field {name}; there are {', '.join(s.row) or 'none'}")
    return s.row[name]


def _member(v, name):
    if isinstance(v.kind, T.StructType):
        for f in v.kind.fields:
            if f.name == name:
                gone = V.when_err(v.col.isNull(), f"none has no field {name}") if v.nullable else None
                return Val(v.col[name], f.dataType, V.errs(v.err, gone))
        raise PipeError(f"no field {name}")
    if isinstance(v.kind, T.VariantType):
        got = F.try_variant_get(v.col, f"$.{name}", "string")
        return Val(got, V.STRING, V.errs(v.err, V.when_err(got.isNull(), f"no field {name}")))
    if V.is_null(v):
        return V.failing(f"none has no field {name}")
    raise PipeError(f"{v.kind.simpleString()} has no field {name}")


def _driver(n, s):
    """``name.field`` of driver values: objects and namespaces."""
    try:
        value = s.env.get(n.value.name)
    except KeyError:
        return None
    if isinstance(value, dict) and n.field in value:
        return _driver_value(value[n.field], s)
    if hasattr(value, "member"):
        return _driver_value(value.member(n.field), s)
    return None


def _constant(node, s):
    """A driver value if the node doesn't depend on the row, else None."""
    if isinstance(node, ast.Lit):
        return node.value
    names = ast.free_names(node)
    if "it" in names or names & set(s.local):
        return None
    try:
        return s.env.evaluate(node)
    except (PipeError, KeyError):
        return None


def _at(n, s):
    if isinstance(n.key, ast.RangeOf):
        return _slice(compile_node(n.value, s), compile_node(n.key.low, s), compile_node(n.key.high, s))
    key = _constant(n.key, s)
    if isinstance(key, str):
        return _get(ast.Get(n.value, key), s)
    return _element(compile_node(n.value, s), compile_node(n.key, s))


def _element(v, i):
    if isinstance(v.kind, T.VariantType) and V.is_text(i):
        raise PipeError("the field name must be known before the rows are read")
    if not V.is_list(v):
        raise PipeError(f"{v.kind.simpleString()} has no places")
    n, p = F.size(v.col), V.number(i).cast("int")
    out = V.when_err((p >= n) | (p < -n), "place outside the list")
    return Val(F.get(v.col, F.when(p < 0, p + n).otherwise(p)), v.kind.elementType, V.errs(v.err, i.err, out))


def _slice(v, a, b):
    if not V.is_list(v):
        raise PipeError("slice needs a list")
    x, y = V.number(a).cast("int"), V.number(b).cast("int")
    bad = V.when_err((x < 0) | (y < 0), "slice takes no negative places")
    got = F.slice(v.col, F.greatest(x, F.lit(0)) + 1, F.greatest(y - F.greatest(x, F.lit(0)) + 1, F.lit(0)))
    return Val(got, v.kind, V.errs(v.err, a.err, b.err, bad))


def _binary(n, s):
    if n.op in ("and", "or"):
        return V.logic(n.op, compile_node(n.left, s), compile_node(n.right, s))
    a, b = compile_node(n.left, s), compile_node(n.right, s)
    if n.op in ("+", "-", "*", "/", "%"):
        return V.arithmetic(n.op, a, b)
    return V.compare(n.op, a, b)


def _unary(n, s):
    v = compile_node(n.value, s)
    return V.negative(v) if n.op == "-" else Val(~V.truthy(v), V.BOOL, v.err, False)


def _match(n, s):
    subject = compile_node(n.subject, s)
    arms = []
    for a in n.arms:
        if a.op in ("Ok", "Err"):
            raise PipeError("Ok and Err patterns take the result of a pipe, not a row value")
        result = compile_node(a.result, s)
        if a.op == "_":
            arms.append((None, None, result))
            break
        test = V.compare(a.op, subject, compile_node(a.value, s))
        arms.append((F.coalesce(test.col, F.lit(False)), test.err, result))
    if not arms:
        return V.failing("no match")
    kind = V.joint_kind([r.kind for _, _, r in arms])
    value, err, open_end = None, None, True
    for test, terr, result in arms:
        col = result.col.cast(kind)
        if test is None:
            value = col if value is None else value.otherwise(col)
            if err is not None:
                err = err.otherwise(result.err if result.err is not None else F.lit(None).cast("string"))
            elif result.err is not None:
                err = result.err
            open_end = False
        else:
            value = F.when(test, col) if value is None else value.when(test, col)
            taken = result.err if result.err is not None else F.lit(None).cast("string")
            # an arm's own failure counts only when no arm before was taken
            err = err if err is not None else F
            if terr is not None:
                err = err.when(terr.isNotNull(), terr)
            err = err.when(test, taken)
    if open_end:
        err = err.otherwise(F.lit("no match"))
    elif all(t is None or te is None for t, te, _ in arms) and all(r.err is None for *_, r in arms):
        err = None
    return Val(value, kind, V.errs(subject.err, err))


def _lambda(n, s):
    raise PipeError("a function is no value of a row")


def _block(n, s):
    local = dict(s.local)
    out = V.literal(None)
    for st in n.body:
        inner = s.inner(local=local)
        if isinstance(st, ast.Assign):
            local[st.name] = out = compile_node(st.value, inner)
        else:
            out = compile_node(st, inner)
    return out


def _pipe(n, s):
    value = compile_node(n.source, s)
    for step in n.steps:
        call = step.call if isinstance(step.call, ast.Call) else ast.Call(step.call)
        value = _invoke(call, s, first=value)
    return value


# -- calls ---------------------------------------------------------------------------------


def dotted(fn) -> str | None:
    if isinstance(fn, ast.Name):
        return fn.name
    if isinstance(fn, ast.Get) and isinstance(fn.value, ast.Name):
        return f"{fn.value.name}.{fn.field}"
    return None


def _call(n, s):
    return _invoke(n, s)


def _invoke(n, s, first: Val | None = None) -> Val:
    title = dotted(n.fn)
    named = dict(n.named)
    if first is None and s.windows and s.row is not None:
        made = _window(title, n, named, s)
        if made is not None:
            return made
    given = [] if first is None else [first]
    fn = None
    if title is not None and title not in s.local:
        fn = s.env.resolve(title)
    if isinstance(fn, Closure):
        args = [*given, *[_argument(a, s) for a in n.args]]
        try:
            return _inline(fn, args, s)
        except Recursion:
            if s.depth or not all(isinstance(a, Val) for a in args):
                raise
            return row_call(per_row(fn, args), args, s)
    if isinstance(fn, RowFunction):
        return row_call(fn, [*given, *[compile_node(a, s) for a in n.args], *[compile_node(v, s) for v in named.values()]], s)
    lib, _, short = (title or "").partition(".")
    home = s.env.library(lib) if short else None
    if home in ("math", "text"):
        table = MATH if home == "math" else TEXT
        if short not in table:
            raise PipeError(f"{home} has no function {short}")
        return table[short](*given, *[compile_node(a, s) for a in n.args], *[compile_node(v, s) for v in named.values()])
    if home == "ml" and short == "dist":
        args = [*given, *[compile_node(a, s) for a in n.args if not isinstance(a, ast.Lit)]]
        metric = named["metric"].value if "metric" in named else next((a.value for a in n.args if isinstance(a, ast.Lit)), "cosine")
        return dist(*args[:2], metric)
    if home == "ml" and short in ("embed", "llm"):
        from sluice.functions import ml

        return ml.remote(short, [*given, *[compile_node(a, s) for a in n.args]], {k: _constant(v, s) if _constant(v, s) is not None else compile_node(v, s) for k, v in named.items()}, s)
    if title in _ROW:
        return _ROW[title](n, s, given)
    if title is None:
        return _applied(n, s, given)
    value = _constant(n, s)
    if value is not None:
        return V.literal(value)
    raise PipeError(f"{title} can't be used inside a row expression")


def _argument(node, s):
    if isinstance(node, ast.Lambda):
        return Closure(node.params, node.body, s)
    title = dotted(node)
    if title and title not in s.local and title != "it":
        fn = s.env.resolve(title)
        if isinstance(fn, Closure):
            return fn
    return compile_node(node, s)


def _applied(n, s, given):
    """Curried calls: f(1)(2), and lambdas called where they stand."""
    args = [*given, *[_argument(a, s) for a in n.args]]
    if isinstance(n.fn, ast.Lambda):
        return _inline(Closure(n.fn.params, n.fn.body, s.env), args, s)
    if isinstance(n.fn, ast.Call):
        fn = _closure_of(n.fn, s)
        return _inline(fn, args, s)
    raise PipeError("this can't be called")


def _closure_of(n, s) -> Closure:
    fn = s.env.resolve(dotted(n.fn)) if dotted(n.fn) else _closure_of(n.fn, s)
    if not isinstance(fn, Closure) or not isinstance(fn.body, ast.Lambda):
        raise PipeError("this can't be called")
    bound = dict(zip(fn.params, [_argument(a, s) for a in n.args]))
    env = fn.env.child(bound) if hasattr(fn.env, "child") else fn.env
    return Closure(fn.body.params, fn.body.body, env)


def _inline(fn: Closure, args: list, s: Scope) -> Val:
    if s.depth >= DEPTH:
        raise Recursion(fn.name)
    if len(args) != len(fn.params):
        raise PipeError(f"{fn.name or 'function'} takes {len(fn.params)} arguments, not {len(args)}")
    bound = dict(zip(fn.params, args))
    vals = {k: v for k, v in bound.items() if isinstance(v, Val)}
    rest = {k: v for k, v in bound.items() if not isinstance(v, Val)}
    env = fn.env.env if isinstance(fn.env, Scope) else fn.env
    outer = fn.env.local if isinstance(fn.env, Scope) else {}
    return compile_node(fn.body, s.inner(env=env.child(rest) if rest else env, local={**outer, **vals}, depth=s.depth + 1))


class Recursion(PipeError):
    pass


def per_row(fn: Closure, args: list[Val]) -> RowFunction:
    """A recursive function as a Python function of one row's values, run by the
    driver's evaluator in the tasks. Its type is that of its value for simple arguments."""
    from sluice.plans.interpreter import alone

    call = alone(fn)
    simple = {T.LongType: 1, T.IntegerType: 1, T.DoubleType: 1.0, T.StringType: "a", T.BooleanType: True}
    try:
        sample = call(*[simple.get(type(a.kind), []) for a in args])
        kind = V.literal(sample).kind
    except Exception:  # no such arguments: told by nothing
        kind = V.STRING
    return RowFunction(call, kind)


def row_call(fn: RowFunction, args: list[Val], s: Scope) -> Val:
    """A Python function per row, in Arrow batches, with retries and a thread
    pool where the step asks for them. A failure becomes the row's error."""
    retries = max([fn.retry, *[int(x) for x in s.notes.get("retry", [])]])
    workers = max([fn.workers, *[int(x) for x in s.notes.get("concurrent", [])]])
    kind = fn.kind or V.STRING
    out = T.StructType([T.StructField("v", kind), T.StructField("e", V.STRING)])
    call = fn.fn
    frees = len(args)

    def one(row):
        last = None
        for _ in range(retries + 1):
            try:
                return call(*row), None
            except Exception as bad:  # the row's error, not the job's
                last = f"{type(bad).__name__}: {bad}"
        return None, last

    def batch(frame):
        import pandas as pd

        rows = list(zip(*[[_plain(x) for x in frame[f"a{i}"]] for i in range(frees)])) if frees else [()] * len(frame)
        if workers > 1:
            from concurrent.futures import ThreadPoolExecutor

            with ThreadPoolExecutor(workers) as pool:
                got = list(pool.map(one, rows))
        else:
            got = [one(r) for r in rows]
        return pd.DataFrame({"v": pd.Series([g[0] for g in got], dtype=object), "e": pd.Series([g[1] for g in got], dtype=object)})

    import pandas as pd

    batch.__annotations__ = {"frame": pd.DataFrame, "return": pd.DataFrame}
    udf = F.pandas_udf(batch, out)  # its uses in one projection share one call per row; project() keeps the result
    packed = F.struct(*[a.col.alias(f"a{i}") for i, a in enumerate(args)]) if args else F.struct(F.lit(0).alias("a0"))
    got = udf(packed)
    return Val(got["v"], kind, V.errs(*[a.err for a in args], got["e"]))


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float) and math.isnan(x):
        return None
    return x


# -- row functions -------------------------------------------------------------------------


def _args(n, s, given):
    return [*given, *[compile_node(a, s) for a in n.args], *[compile_node(v, s) for _, v in n.named]]


def _cast(fn):
    return lambda n, s, given: fn(*_args(n, s, given))


def _len(n, s, given):
    (v,) = _args(n, s, given)
    if not V.is_list(v):
        raise PipeError(f"len of {v.kind.simpleString()}")
    return Val(F.size(v.col).cast("bigint"), V.LONG, V.errs(v.err, V.when_err(v.col.isNull(), "len of none")))


def _end(place):
    def f(n, s, given):
        (v,) = _args(n, s, given)
        return Val(F.try_element_at(v.col, F.lit(place)), v.kind.elementType, v.err)

    return f


def _item(v: Val, s: Scope, body, param: str | None = None):
    """A function for transform and filter: ``it`` or ``param`` is the element."""
    kind = v.kind.elementType

    def run(x):
        inner = Val(x, kind)
        row = {f.name: Val(x[f.name], f.dataType) for f in kind.fields} if isinstance(kind, T.StructType) else None
        if param:
            return compile_node(body, s.inner(local={**s.local, param: inner}, windows=False))
        return compile_node(body, s.inner(row=row, it=inner, windows=False))

    return run


def _body(node):
    return (node.body, node.params[0]) if isinstance(node, ast.Lambda) else (node, None)


def _kind_of(make, v):
    return make(F.col("x")).kind


def _map(n, s, given):
    v, (body, param) = (given or [compile_node(n.args[0], s)])[0], _body(n.args[-1])
    run = _item(v, s, body, param)
    kind = _kind_of(run, v)
    got = F.transform(v.col, lambda x: run(x).col)
    return Val(got, T.ArrayType(kind), v.err)


def _filter(n, s, given):
    v, (body, param) = (given or [compile_node(n.args[0], s)])[0], _body(n.args[-1])
    run = _item(v, s, body, param)
    return Val(F.filter(v.col, lambda x: V.truthy(run(x))), v.kind, v.err)


def _reduce(n, s, given):
    args = list(n.args)
    v = given[0] if given else compile_node(args.pop(0), s)
    init, fn = compile_node(args[0], s), args[1]
    if not isinstance(fn, ast.Lambda) or len(fn.params) != 2:
        raise PipeError("reduce needs a function of two arguments")
    item = v.kind.elementType

    def step(kind):
        def f(acc, x):
            return compile_node(fn.body, s.inner(local={**s.local, fn.params[0]: Val(acc, kind), fn.params[1]: Val(x, item)}, windows=False))

        return f

    kind = step(init.kind)(F.col("a"), F.col("x")).kind
    return Val(F.aggregate(v.col, init.col.cast(kind), lambda a, x: step(kind)(a, x).col.cast(kind)), kind, V.errs(v.err, init.err))


def _set(n, s, given):
    v, i, x = _args(n, s, given)
    kind = V.joint_kind([v.kind.elementType, x.kind])
    p = V.number(i).cast("int")
    out = V.when_err((p < 0) | (p >= F.size(v.col)), "place outside the list")
    got = F.transform(v.col.cast(T.ArrayType(kind)), lambda e, j: F.when(j == p, x.col.cast(kind)).otherwise(e))
    return Val(got, T.ArrayType(kind), V.errs(v.err, i.err, x.err, out))


def _concat(n, s, given):
    args = _args(n, s, given)
    kind = T.ArrayType(V.joint_kind([a.kind.elementType for a in args]))
    return Val(F.concat(*[a.col.cast(kind) for a in args]), kind, V.errs(*[a.err for a in args]))


def _get_fn(n, s, given):
    args = [*given]
    nodes = list(n.args)
    v = args[0] if args else compile_node(nodes.pop(0), s)
    key = _constant(nodes[0], s)
    return _member(v, key) if isinstance(key, str) else _element(v, compile_node(nodes[0], s))


def _find(n, s, given):
    key = ast.canonical(n)
    if key not in s.lookups:
        raise PipeError("find looks up a table by a field known before the rows are read")
    name, kind = s.lookups[key]
    return Val(F.col(f"`{name}`"), kind)


_ROW = {
    "str": _cast(V.as_text), "int": _cast(V.as_int), "float": _cast(V.as_float), "len": _len, "first": _end(1), "last": _end(-1),
    "map": _map, "filter": _filter, "reduce": _reduce, "set": _set, "concat": _concat, "get": _get_fn, "find": _find,
    "slice": lambda n, s, given: _slice(*_args(n, s, given)),
}


# -- windows -------------------------------------------------------------------------------


def column_of(node) -> str | None:
    """The column that ``col.x``, ``it.x`` or "x" names."""
    if isinstance(node, ast.Get) and isinstance(node.value, ast.Name) and node.value.name in ("col", "it"):
        return node.field
    if isinstance(node, ast.Lit) and isinstance(node.value, str):
        return node.value
    return None


def keys_of(node, s) -> list[str]:
    if node is None:
        return []
    got = s.env.evaluate(node)
    return [got] if isinstance(got, str) else list(got)


def clean(v: Val) -> Column:
    """NaN counts as missing in aggregates."""
    return F.nanvl(v.col.cast("double"), F.lit(None).cast("double")) if V.is_real(v) else v.col


def aggregate(name: str, v: Val | None) -> Val:
    """One of the five aggregates of a column, over the rows of a group."""
    if name == "count":
        return Val(F.count(F.lit(1)), V.LONG, nullable=False)
    if v is None:
        raise PipeError(f"{name} needs a column")
    if name in ("sum", "mean") and not (V.is_number(v) or V.is_null(v)):
        if name == "sum" and V.is_text(v):
            raise PipeError("sum of texts has no order here: use a function of the rows")
        raise PipeError(f"{name} of {v.kind.simpleString()}")
    x = clean(v)
    if name == "sum":
        zero = F.lit(0).cast("bigint") if V.is_int(v) else F.lit(0.0)
        return Val(F.coalesce(F.sum(x.cast("bigint") if V.is_int(v) else x), zero), V.LONG if V.is_int(v) else V.DOUBLE, nullable=False)
    if name == "mean":
        return Val(F.avg(x), V.DOUBLE)
    return Val(F.min(x) if name == "min" else F.max(x), V.DOUBLE if V.is_real(v) else v.kind)


def _window(title, n, named, s: Scope) -> Val | None:
    plain = title in (*AGGREGATES, "rank", "rolling") and title not in s.local
    if not plain:
        return None
    f = s.frame
    if title in AGGREGATES:
        column = column_of(n.args[0]) if n.args else None
        if n.args and column is None:
            return None
        by = keys_of(named.get("by"), s)
        value = _field(s, column) if column else None
        if title == "count" and column:
            agg = Val(F.count(clean(value)), V.LONG, nullable=False)
        else:
            agg = aggregate(title, value)
        keys = [*f.within, *by]
        if not keys:
            return Val(single(f.data.select(agg.col)), agg.kind)
        got = agg.col.over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys])) if title not in ("sum",) else F.coalesce(
            F.sum(clean(value)).over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys])), F.lit(0).cast(agg.kind)
        )
        for k in by:
            got = F.when(F.col(f"`{k}`").isNotNull(), got)
        return Val(got, agg.kind)
    column = column_of(n.args[0])
    value = _field(s, column)
    by = keys_of(named.get("by"), s)
    keys = [F.col(f"`{k}`") for k in (*f.within, *by)]
    gone = value.col.isNull() if not V.is_real(value) else value.col.isNull() | F.isnan(value.col.cast("double"))
    for k in by:
        gone = gone | F.col(f"`{k}`").isNull()
    if title == "rank":
        down = "dir" in named and s.env.evaluate(named["dir"]) == "desc"
        # a missing value has no rank: the whole pipe fails, as a cast to a number would
        guard = F.when(gone, F.raise_error(F.lit(f"rank: {column} has missing values")))
        if not keys:
            s.notes.setdefault("ranked", {})[column, down] = name = f"__orank_{column}_{'d' if down else 'a'}"
            return Val(guard.otherwise(F.col(f"`{name}`")), V.LONG)
        order = value.col.desc() if down else value.col.asc()
        got = F.rank().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint")
        return Val(guard.otherwise(got) if value.nullable else got, V.LONG)
    size = s.env.evaluate(n.args[1])
    how = n.args[2]
    how = how.value if isinstance(how, ast.Lit) else how.field if isinstance(how, ast.Get) else how.name
    if not f.order:
        raise NeedsOrder
    w = Window.partitionBy(*keys).orderBy(*f.order_cols()).rowsBetween(-(int(size) - 1), 0)
    x = clean(value)
    real = x.cast("double")
    made = {
        "mean": F.avg(x), "sum": F.sum(real), "min": F.min(real), "max": F.max(real), "count": F.count(x),
        "std": F.stddev_samp(real), "var": F.var_samp(real), "median": F.percentile(real, F.lit(0.5)),
        "first": F.first(real, ignorenulls=True), "last": F.last(real, ignorenulls=True),
    }.get(how)
    n = F.count(x).over(w).cast("double")
    # the sample's moments of a window from those of its values alone
    more = {
        "sem": lambda: F.stddev_samp(real).over(w) / F.sqrt(n - 1),  # so in the windows of the documented functions
        "skew": lambda: F.when(n > 2, F.skewness(real).over(w) * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurt": lambda: F.when(n > 3, ((n + 1) * F.kurtosis(real).over(w) + 6) * (n - 1) / ((n - 2) * (n - 3))),
        "nunique": lambda: F.size(F.collect_set(real).over(w)),  # bounded by the window
    }
    if made is None and how not in more:
        raise PipeError(f"rolling knows no {how}")
    seen = F.count(F.lit(1)) if how == "count" else F.count(x)
    got = F.when(seen.over(w) >= size, (made.over(w) if made is not None else more[how]()).cast("double"))
    for k in by:
        got = F.when(F.col(f"`{k}`").isNotNull(), got)
    return Val(got, V.DOUBLE)


class NeedsOrder(Exception):
    """The step must first give its rows an order."""


def apply_ranks(f: Frame, wanted: dict) -> Frame:
    for (column, down), name in wanted.items():
        f = f.with_data(ranked(f.data, column, down, name))
    return f


_COMPILE = {
    ast.Lit: _lit, ast.Text: _text, ast.Name: _name, ast.ListOf: _list, ast.ObjectOf: _object, ast.RangeOf: _range, ast.Get: _get,
    ast.At: _at, ast.Binary: _binary, ast.Unary: _unary, ast.Match: _match, ast.Lambda: _lambda, ast.Block: _block, ast.Pipe: _pipe,
    ast.Call: _call,
}
