"""The table steps: each lowers one call to DataFrame operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.lang import ast
from sluice.plans import compiler as C
from sluice.plans import values as V
from sluice.plans.frame import HIDDEN, Frame, as_frame, hidden
from sluice.plans.values import PipeError
from sluice.runtime import free_name, materialize

LOOKUP = f"{HIDDEN}find"
CROSSED = 10_000  # rows of a table of values


def _q(name: str):
    return F.col(f"`{name}`")


# -- lookups in other tables (find) --------------------------------------------------------


def _finds(node):
    for n in ast.walk(node):
        if isinstance(n, ast.Call) and isinstance(n.fn, ast.Name) and n.fn.name == "find" and len(n.args) == 3:
            yield n


def with_lookups(f: Frame, nodes, env) -> tuple[Frame, dict]:
    """``find(T, "c", e)`` becomes one left join on the first row per key of T.
    No size is assumed: the optimizer sees T's statistics and chooses."""
    found: dict = {}
    for node in nodes:
        for n in _finds(node):
            key = ast.canonical(n)
            if key in found or "it" not in ast.free_names(n):
                continue
            table = as_frame(f.data.sparkSession, env.evaluate(n.args[0])).sequenced()
            column = env.evaluate(n.args[1])
            value = C.compile_node(n.args[2], C.row_scope(f, env, windows=False))
            if column not in table.columns:
                raise PipeError(f"find: no field {column}")
            name, k = f"{LOOKUP}{len(found)}", f"{LOOKUP}key{len(found)}"
            row = F.struct(*[_q(c).alias(c) for c in table.columns])
            order = F.struct(*[_q(c) for c, _ in table.order])
            firsts = table.data.groupBy(_q(column).alias(k)).agg(F.min_by(row, order).alias(name))
            f = f.kept()
            joined = f.data.join(firsts, V.equal(value, V.Val(F.col(k), table.kinds()[column])) if V.is_real(value) else value.col.eqNullSafe(F.col(k)), "left")
            f = f.with_data(joined.drop(k))
            kind = T.StructType([T.StructField(c, table.kinds()[c]) for c in table.columns])
            found[key] = (name, kind)
    return f, found


def _compiled(f: Frame, nodes: dict, env, notes, windows=True):
    """Compile named row expressions; gives the frame they hold for."""
    f, lookups = with_lookups(f, nodes.values(), env)
    while True:
        scope = C.row_scope(f, env, windows=windows, lookups=lookups, notes={**notes})
        try:
            out = {k: C.compile_node(n, scope) for k, n in nodes.items()}
            break
        except C.NeedsOrder:
            f = f.sequenced()
    extra = scope.notes.get("ranked", {})
    if extra:
        f = C.apply_ranks(f.kept(), extra)
    return f, out


def project(f: Frame, keep: list[str], new: dict[str, V.Val], label: str) -> Frame:
    """``keep`` columns and ``new`` ones; rows where a new one fails are routed
    to the errors. Where nothing can fail it is a single projection."""
    secret = [c for c in f.secret if not c.startswith((LOOKUP, f"{HIDDEN}rank_", f"{HIDDEN}err"))]
    cols = {n: v.col.alias(n) for n, v in new.items()}
    order = list(keep) + [n for n in new if n not in keep]
    pick = [cols.get(c, _q(c)) for c in order]
    failing = {n: v.err for n, v in new.items() if v.err is not None}
    if not failing:
        return f.with_data(f.data.select(*pick, *[_q(c) for c in secret]))
    where, what = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, e in reversed(list(failing.items())):
        where = F.when(e.isNotNull(), F.lit(f"{label}({n})")).otherwise(where)
        what = F.coalesce(e, what)
    err, at, old = f"{HIDDEN}err", f"{HIDDEN}errat", f"{HIDDEN}errrow"
    packed = F.struct(*[_q(c).alias(c) for c in f.columns]).alias(old)
    tagged = f.data.select(*pick, *[_q(c) for c in secret], what.alias(err), where.alias(at), packed)
    if _costly(tagged):  # Python ran: keep its results rather than run it for each branch
        tagged = materialize(tagged)
    good = tagged.filter(F.col(err).isNull()).drop(err, at, old)
    bad = tagged.filter(F.col(err).isNotNull()).select(f"{old}.*", F.col(err).alias("_error"), F.col(at).alias("_step"))
    return replace(f.with_data(good), errors=f.add_errors(bad))


def _costly(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed().toString()
    return "batch(" in plan or "PythonUDF" in plan or "pythonUDF" in plan


def strict(v: V.Val):
    """The value, or a failure of the whole pipe."""
    if v.err is None:
        return v.col
    return F.when(v.err.isNotNull(), F.raise_error(v.err)).otherwise(v.col)


# -- steps ---------------------------------------------------------------------------------


def _one(call, name):
    args = [a for a in call.args]
    if len(args) != 1 or call.named:
        raise PipeError(f"{name} takes one argument")
    return args[0]


def _row_body(node, env):
    """An expression over ``it``, or a function of one argument made into one."""
    if isinstance(node, ast.Lambda) and len(node.params) == 1:
        return ast.Call(node, (ast.Name("it"),))
    title = C.dotted(node)
    if title and title != "it" and isinstance(env.resolve(title), (C.Closure, C.RowFunction)):
        return ast.Call(node, (ast.Name("it"),))
    return node


def _lower_lambda(node, env):
    """``row -> e``: the parameter stands for ``it``."""
    if isinstance(node, ast.Lambda) and len(node.params) == 1:
        return _rename(node.body, node.params[0])
    return _row_body(node, env)


def _rename(node, name):
    from dataclasses import fields, is_dataclass

    if isinstance(node, ast.Name):
        return ast.Name("it") if node.name == name else node
    if isinstance(node, ast.Lambda) and name in node.params:
        return node
    if isinstance(node, tuple):
        return tuple(_rename(x, name) for x in node)
    if is_dataclass(node):
        return type(node)(**{x.name: _rename(getattr(node, x.name), name) for x in fields(node)})
    return node


def _loose(node, scope):
    """A superset of the rows that a predicate keeps or fails on, in a shape that
    reaches the scan; None where there is none. The strict predicate follows."""
    if not isinstance(node, ast.Binary):
        return None
    if node.op in ("and", "or"):
        a, b = _loose(node.left, scope), _loose(node.right, scope)
        if node.op == "and":  # a failure on the right needs the left to hold
            return a
        return None if a is None or b is None else a | b
    for field, other, flip in ((node.left, node.right, False), (node.right, node.left, True)):
        column = C.column_of(field) if isinstance(field, ast.Get) and isinstance(field.value, ast.Name) and field.value.name == "it" else None
        if column in scope.row and isinstance(other, ast.Lit) and other.value is not None and not isinstance(other.value, bool):
            v, w = scope.row[column], V.literal(other.value)
            if not (V.is_number(v) and V.is_number(w)) and not (V.is_text(v) and V.is_text(w)):
                return None
            op = {">": "<", "<": ">", ">=": "<=", "<=": ">="}.get(node.op, node.op) if flip else node.op
            x, y = v.col, F.lit(other.value)
            if op in ("==", "!="):
                return x == y if op == "==" else None
            hit = x > y if op == ">" else x < y if op == "<" else x >= y if op == ">=" else x <= y
            return hit | x.isNull() if v.nullable else hit
    return None


def filter_(f, call, env, notes):
    body = _lower_lambda(_one(call, "filter"), env)
    if not _has_window(body):
        loose = _loose(body, C.row_scope(f, env))
        if loose is not None:
            f = f.with_data(f.data.filter(loose))
    f, vals = _compiled(f, {"p": body}, env, notes, windows=True)
    v = vals["p"]
    keep = V.truthy(v)
    if v.err is not None:
        keep = F.when(v.err.isNotNull(), F.raise_error(v.err).cast("boolean")).otherwise(keep)
    windowed = f.data.withColumn(f"{HIDDEN}keep", keep).filter(F.col(f"{HIDDEN}keep")).drop(f"{HIDDEN}keep") if _has_window(body) else f.data.filter(keep)
    return f.with_data(windowed.drop(*[c for c in windowed.columns if c.startswith((LOOKUP, f"{HIDDEN}rank_"))]))


def _has_window(node) -> bool:
    return any(isinstance(n, ast.Call) and C.dotted(n.fn) in (*C.AGGREGATES, "rank", "rolling") for n in ast.walk(node))


def map_(f, call, env, notes, index: str | None = None):
    body = _lower_lambda(_one(call, "map"), env)
    if index is None and isinstance(body, ast.ObjectOf):
        f, lookups = with_lookups(f, [body], env)
        fields = C.object_fields(body, C.row_scope(f, env, windows=False, lookups=lookups, notes={**notes}))
        new = {k: V.Val(strict(v), v.kind) for k, v in fields.items()}
    else:
        f, vals = _compiled(f, {"value": body}, env, notes, windows=False)
        v = vals["value"]
        new = {x.name: V.Val(strict(v)[x.name], x.dataType) for x in v.kind.fields} if isinstance(v.kind, T.StructType) else {"value": V.Val(strict(v), v.kind)}
    out = project(f, [], new, "map")
    return replace(out, errors=None, artifacts={})


def mapi(f, call, env, notes):
    """``it`` is {idx, val}; idx counts from 0 in row order."""
    f = f.indexed(f"{HIDDEN}idx")
    row = F.struct(*[_q(c).alias(c) for c in f.columns])
    keep = f.with_data(f.data.select(F.col(f"{HIDDEN}idx").alias("idx"), row.alias("val"), *[_q(c) for c in f.secret if c != f"{HIDDEN}idx"]))
    return map_(keep, call, env, notes)


def add(f, call, env, notes):
    if call.args or not call.named:
        raise PipeError("add takes named expressions")
    nodes = dict(call.named)
    f, vals = _compiled(f, nodes, env, notes)
    return project(f, f.columns, vals, "add")


def select(f, call, env, notes):
    keep = [env.evaluate(a) for a in call.args]
    nodes = dict(call.named)
    f, vals = _compiled(f, nodes, env, notes) if nodes else (f, {})
    return project(f, [k for k in keep if k in f.columns and k not in vals], vals, "select")


def drop(f, call, env, notes):
    gone = [env.evaluate(a) for a in call.args]
    return f.with_data(f.data.drop(*[g for g in gone if not hidden(g)]))


def rename(f, call, env, notes):
    if len(call.named) != 1:
        raise PipeError("rename takes exactly one old: \"new\" pair")
    old, new = call.named[0][0], env.evaluate(call.named[0][1])
    if old not in f.columns:
        raise PipeError(f"rename: no field {old}")
    gone = [c for c in f.columns if c == new and c != old]
    return f.with_data(f.data.drop(*gone).withColumnRenamed(old, new))


def recover(f, call, env, notes):
    if f.errors is None:
        return f
    name, node = call.named[0]
    bad = Frame(f.errors)
    fixed = project(*_recovered(bad, name, node, env, notes), "recover")
    rows = fixed.data.drop(*fixed.secret)
    f = f.kept()
    flag = f.fresh("r")
    if f.order:  # recovered rows come after all others
        first, again = f.data.withColumn(flag, F.lit(0)), rows.withColumn(flag, F.lit(1))
        lead = f.order[0][0]
        if isinstance(f.data.schema[lead].dataType, T.LongType):
            again = again.withColumn(lead, F.monotonically_increasing_id())
        data = first.unionByName(again, allowMissingColumns=True)
        return replace(f, data=data, order=((flag, True), *f.order), errors=fixed.errors)
    return replace(f, data=f.data.unionByName(rows, allowMissingColumns=True), errors=fixed.errors)


def _recovered(bad, name, node, env, notes):
    bad, vals = _compiled(bad, {name: node}, env, notes, windows=False)
    return bad, bad.columns, vals


def sort(f, call, env, notes):
    named = dict(call.named)
    by = env.evaluate(named.get("by") or call.args[0])
    down = "dir" in named and env.evaluate(named["dir"]) == "desc"
    if by not in f.columns:
        raise PipeError(f"sort: no field {by}")
    f = f.kept()
    value = _q(by)
    gone = value.isNull()
    if isinstance(f.kinds()[by], V.REALS):
        gone = gone | F.isnan(value.cast("double"))
    name = f.fresh("s")
    key = F.when(gone, F.raise_error(F.lit(f"sort: {by} has missing values")).cast(f.kinds()[by])).otherwise(value)
    nullable = f.data.schema[by].nullable
    return replace(f, data=f.data.withColumn(name, key if nullable else value), order=((name, not down), *f.order))


def take(f, call, env, notes):
    n = int(env.evaluate(_one(call, "take")))
    f = f.sequenced()
    if f.within:
        w = Window.partitionBy(*f.within).orderBy(*f.order_cols())
        if n < 0:
            size = F.count(F.lit(1)).over(Window.partitionBy(*f.within))
            data = f.data.withColumn(f"{HIDDEN}n", F.row_number().over(w) - size).filter(F.col(f"{HIDDEN}n") <= n)
        else:
            data = f.data.withColumn(f"{HIDDEN}n", F.row_number().over(w)).filter(F.col(f"{HIDDEN}n") <= n)
        return f.with_data(data.drop(f"{HIDDEN}n"))
    if n >= 0:
        return f.with_data(f.data.orderBy(*f.order_cols()).limit(n))
    g = f.indexed(f"{HIDDEN}n")
    return f.with_data(g.data.filter(F.col(f"{HIDDEN}n") < g.data.count() + n).drop(f"{HIDDEN}n"))


def unique(f, call, env, notes):
    named = dict(call.named)
    node = named.get("by") or (call.args[0] if call.args else None)
    if node is None:
        if any(isinstance(k, (T.ArrayType, T.MapType)) for k in f.kinds().values()):
            raise PipeError("unique: rows with lists can't be compared")
        if not f.ordered and not f.order:
            return f.with_data(f.data.dropDuplicates())
        keys = f.columns
    else:
        got = env.evaluate(node)
        keys = [got] if isinstance(got, str) else list(got)
    f = f.sequenced()
    w = Window.partitionBy(*f.within, *[_q(k) for k in keys]).orderBy(*f.order_cols())
    return f.with_data(f.data.withColumn(f"{HIDDEN}n", F.row_number().over(w)).filter(F.col(f"{HIDDEN}n") == 1).drop(f"{HIDDEN}n"))


def cross(f, call, env, notes):
    name, values = env.evaluate(call.args[0]), env.evaluate(call.args[1])
    f = f.kept()
    pos = f.fresh("x")
    if isinstance(values, Frame):  # values are settings of the step: their rows, as objects
        got = values.visible().limit(CROSSED + 1).collect()
        if len(got) > CROSSED:
            raise PipeError(f"cross takes at most {CROSSED} values; join tables with join")
        values = [r.asDict(recursive=True) for r in got]
    lits = V.literal(list(values))
    data = f.data.select(*[_q(c) for c in f.columns if c != name], *[_q(c) for c in f.secret], F.posexplode(lits.col).alias(pos, f"{HIDDEN}v"))
    place = [c for c in f.columns if c != name] + [name] if name not in f.columns else f.columns
    data = data.withColumnRenamed(f"{HIDDEN}v", name)
    data = data.select(*[_q(c) for c in place], *[_q(c) for c in data.columns if hidden(c)])
    return replace(f, data=data, order=(*f.order, (pos, True)) if f.order else ())


def flatten(f, call, env, notes):
    name = env.evaluate(_one(call, "flatten"))
    kind = f.kinds().get(name)
    if not isinstance(kind, T.ArrayType):
        raise PipeError(f"flatten: {name} is no list")
    f = f.kept()
    pos, item = f.fresh("x"), f"{HIDDEN}v"
    rest = [c for c in f.columns if c != name]
    data = f.data.select(*[_q(c) for c in rest], *[_q(c) for c in f.secret], F.posexplode(_q(name)).alias(pos, item))
    hid = [_q(c) for c in data.columns if hidden(c) and c != item]
    if isinstance(kind.elementType, T.StructType):
        inner = [x.name for x in kind.elementType.fields]
        cols = [F.col(item)[c].alias(c) if c in inner else _q(c) for c in rest] + [F.col(item)[c].alias(c) for c in inner if c not in rest]
        data = data.select(*cols, *hid)
    else:
        data = data.select(*[_q(c) for c in rest if c != "value"], F.col(item).alias("value"), *hid)
    return replace(f, data=data, order=(*f.order, (pos, True)) if f.order else ())


def join(f, call, env, notes):
    """Inner join on one key: at most one match per left row, the last right row
    of the key; right values win over left ones of the same name; null keys meet."""
    named = dict(call.named)
    other = as_frame(f.data.sparkSession, env.evaluate(call.args[0]))
    on = env.evaluate(named.get("on") or call.args[1])
    if on not in f.columns or on not in other.columns:
        raise PipeError(f"join: no field {on}")
    right = other.sequenced()
    k, r = f"{HIDDEN}joinkey", f"{HIDDEN}joinrow"
    order = F.struct(*[_order_key(right, c, up) for c, up in right.order])
    row = F.struct(*[_q(c).alias(c) for c in right.columns])
    lasts = right.data.groupBy(_q(on).alias(k)).agg(F.max_by(row, order).alias(r))
    f = f.kept()
    joined = f.data.join(lasts, _q(on).eqNullSafe(F.col(k)), "inner")
    if isinstance(f.kinds()[on], V.REALS):
        joined = joined.filter(~F.coalesce(F.isnan(_q(on).cast("double")), F.lit(False)))
    cols = [F.col(r)[c].alias(c) if c in right.columns else _q(c) for c in f.columns]
    cols += [F.col(r)[c].alias(c) for c in right.columns if c not in f.columns]
    return f.with_data(joined.select(*cols, *[_q(c) for c in f.secret]))


def _order_key(f: Frame, name: str, up: bool):
    if up:
        return _q(name)
    if isinstance(f.data.schema[name].dataType, (*V.INTS, *V.REALS)):
        return -_q(name)
    raise PipeError("join: sort the other table upwards or by a number first")


def concat(f, call, env, notes):
    tables = [f, *[as_frame(f.data.sparkSession, env.evaluate(a)) for a in call.args]]
    return concat_frames(tables)


def concat_frames(tables: list[Frame]) -> Frame:
    ordered = all(t.ordered for t in tables)
    if not ordered:
        data = tables[0].unordered()
        for t in tables[1:]:
            data = data.unionByName(t.unordered(), allowMissingColumns=True)
        return Frame(data, ordered=False)
    parts = []
    for n, t in enumerate(tables):
        t = t.indexed(f"{HIDDEN}i") if len(t.order) != 1 or not isinstance(t.sequenced().data.schema[t.sequenced().order[0][0]].dataType, T.LongType) or not t.sequenced().order[0][1] else t.with_data(t.data.withColumn(f"{HIDDEN}i", _q(t.order[0][0])))
        parts.append(t.data.select(*[_q(c) for c in t.columns], F.lit(n).alias(f"{HIDDEN}k0"), F.col(f"{HIDDEN}i").cast("bigint").alias(f"{HIDDEN}k1")))
    data = parts[0]
    for p in parts[1:]:
        data = data.unionByName(p, allowMissingColumns=True)
    return Frame(data, ((f"{HIDDEN}k0", True), (f"{HIDDEN}k1", True)))


# -- aggregation ---------------------------------------------------------------------------

_VECTOR = ("sum", "mean", "min", "max")


def collapse(f, call, env, notes):
    named = dict(call.named)
    by = C.keys_of(named.pop("by"), C.row_scope(f, env)) if "by" in named else []
    if call.args and not by:
        raise PipeError("collapse takes named aggregates")
    for k in by:
        if k not in f.columns:
            raise PipeError(f"collapse: no field {k}")
    scope = C.row_scope(f, env, windows=False)
    keys = [*f.within, *by]
    data = f.data
    for k in by:  # groups without a key, or with NaN for one, are left out
        data = data.filter(_q(k).isNotNull())
        if isinstance(f.kinds()[k], V.REALS):
            data = data.filter(~F.isnan(_q(k).cast("double")))
    base, vectors, tops, pipes, g = {}, {}, {}, {}, f
    for name, node in named.items():
        column = C.column_of(node.args[0]) if isinstance(node, ast.Call) and node.args else None
        title = C.dotted(node.fn) if isinstance(node, ast.Call) else None
        if title in C.AGGREGATES and column and column not in f.columns:
            raise PipeError(f"collapse: no field {column}")
        if title in _VECTOR and column and isinstance(f.kinds()[column], T.ArrayType):
            vectors[name] = (title, column)
        elif title in C.AGGREGATES:
            base[name] = C.aggregate(title, scope.row[column] if column else None).col
        elif _is_function(node, env) and (best := _best_rows(node, f, env)) is not None:
            tops[name] = best
        elif _is_function(node, env) and (steps := _pushed_steps(node, env)) is not None:
            pipes[name] = steps
        elif _is_function(node, env):
            if not g.order:
                g = g.sequenced()
                data = _reorder(g, by, f)
            base[name] = _of_rows(node, g, env)
        else:
            base[name] = V.literal(env.evaluate(node)).col
    aggs = [c.alias(n) for n, c in base.items()] or [F.count(F.lit(1)).alias(f"{HIDDEN}any")]
    out = data.groupBy(*[_q(k) for k in keys]).agg(*aggs) if keys else data.agg(*aggs)
    for name, (title, column) in vectors.items():
        out = _vector(out, data, keys, name, title, column)
    for name, (key, down, n) in tops.items():
        out = _top_rows(out, data if f.order else _reorder(f.sequenced(), by, f), keys, f if f.order else f.sequenced(), name, key, down, n)
    for name, steps in pipes.items():
        out = _piped_rows(out, f, keys, by, steps, name, env)
    wanted = [*by, *[n for n in call_order(call) if n in named]]
    order = []
    picked = [_q(c) for c in wanted]
    for k in keys:
        h = f"{HIDDEN}by{len(order)}"
        picked.append(_q(k).alias(h) if not hidden(k) else _q(k))
        if not hidden(k):
            order.append((h, True))
    lead = [(c, up) for c, up in f.order if c in f.within]
    return replace(f, data=out.select(*picked), order=(*lead, *order), ordered=True)


def _reorder(g, by, f):
    data = g.data
    for k in by:
        data = data.filter(_q(k).isNotNull())
    return data


def call_order(call):
    return [n for n, _ in call.named if n != "by"]


def _is_function(node, env) -> bool:
    return isinstance(node, ast.Lambda) or (C.dotted(node) is not None and isinstance(env.resolve(C.dotted(node)), C.Closure))


def _vector(out, data, keys, name, title, column):
    """Element-wise aggregate: one group per key and place, put together again."""
    fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[title]
    cells = data.select(*[_q(k) for k in keys], F.posexplode(_q(column)).alias("_p", "_x"))
    x = F.nanvl(F.col("_x").cast("double"), F.lit(None).cast("double"))
    placed = cells.groupBy(*[_q(k) for k in keys], "_p").agg(fn(x).alias("_v"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"]).alias(name)
    if not keys:
        return out.join(placed.agg(whole)) if out.columns else placed.agg(whole)
    made = placed.groupBy(*[_q(k) for k in keys]).agg(whole)
    same = [made[k].alias(f"_m_{k}") for k in keys]
    made = made.select(*same, name)
    return out.join(made, [out[k].eqNullSafe(made[f"_m_{k}"]) for k in keys], "left").drop(*[f"_m_{k}" for k in keys])


def _steps_of(node, env) -> tuple[str, list] | None:
    """(parameter, steps) of a function that pipes a group's rows, else None."""
    fn = node if isinstance(node, ast.Lambda) else env.resolve(C.dotted(node))
    body, param = fn.body, fn.params[0]
    if isinstance(body, ast.Pipe) and isinstance(body.source, ast.Name) and body.source.name == param:
        return param, [s.call if isinstance(s.call, ast.Call) else ast.Call(s.call) for s in body.steps]
    return None


def _best_rows(node, f: Frame, env) -> tuple[str, bool, int] | None:
    """(key, descending, n) of ``rows |> sort(by: key) |> take(n)``, else None."""
    got = _steps_of(node, env)
    if got is None or [C.dotted(s.fn) for s in got[1]] != ["sort", "take"]:
        return None
    sort_, take_ = got[1]
    named = dict(sort_.named)
    key, n = env.evaluate(named.get("by") or sort_.args[0]), env.evaluate(take_.args[0])
    if key not in f.columns or not isinstance(n, int) or n < 0:
        return None
    return key, "dir" in named and env.evaluate(named["dir"]) == "desc", n


#: Steps of a function of rows that work on the group's list.
_LISTED = {"map", "filter", "reduce", "len", "first", "last", "get", "slice", "take", "sort", "select", "drop", "add", "collapse"}


def _pushed_steps(node, env):
    """Steps of a function of rows that lists can't run, where ``each`` runs them
    for all groups at once; else None."""
    got = _steps_of(node, env)
    if got is None or getattr(env, "run", None) is None:
        return None
    names = [C.dotted(s.fn) for s in got[1]]
    from sluice.plans.interpreter import PUSHED

    return got[1] if not set(names) <= _LISTED and set(names) <= PUSHED else None


def _piped_rows(out, f: Frame, keys, by, steps, name, env):
    """The rows that a sub-pipe gives for each group, as a list."""
    groups = by or [free_name(f.columns, "whole")]
    source = f if by else f.with_data(f.data.withColumn(groups[0], F.lit(1)))
    got = env.run.each_pushed(source, groups, [ast.Step(s, True, ()) for s in steps], env)
    if not isinstance(got, Frame):
        raise PipeError(got.msg)
    got = got.sequenced()
    columns = [c for c in got.columns if by or c not in groups]
    row = F.struct(*[_q(c).alias(c) for c in columns])
    order = F.struct(*[_q(c).alias(f"o{i}") if up else (-_q(c)).alias(f"o{i}") for i, (c, up) in enumerate(got.order)])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("r")))), lambda x: x["r"]).alias(name)
    if not by:
        made = got.data.agg(listed)
        return out.join(made) if out.columns else made
    made = got.data.groupBy(*[_q(k).alias(f"_m_{k}") for k in by]).agg(listed)
    none = F.array().cast(made.schema[name].dataType)
    joined = out.join(made, [out[k].eqNullSafe(made[f"_m_{k}"]) for k in by], "left").drop(*[f"_m_{k}" for k in by])
    return joined.withColumn(name, F.coalesce(name, none))


def _top_rows(out, data, keys, f: Frame, name, key, down, n):
    """The first n rows of each group as a list; all others are dropped by a
    limit within the window, so no list is longer than n."""
    place = f"{HIDDEN}n"
    w = Window.partitionBy(*[_q(k) for k in keys]).orderBy(_q(key).desc() if down else _q(key).asc(), *f.order_cols())
    row = F.struct(*[_q(c).alias(c) for c in f.columns])
    few = data.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), row.alias("r")))), lambda x: x["r"]).alias(name)
    if not keys:
        return out.join(few.agg(listed)) if out.columns else few.agg(listed)
    made = few.groupBy(*[_q(k).alias(f"_m_{k}") for k in keys]).agg(listed)
    return out.join(made, [out[k].eqNullSafe(made[f"_m_{k}"]) for k in keys], "left").drop(*[f"_m_{k}" for k in keys])


def _of_rows(node, f: Frame, env):
    """A function of a group's rows as an aggregate. The shapes that need only
    one row use max_by / min_by; others work on the group's sorted list of rows."""
    fn = node if isinstance(node, ast.Lambda) else env.resolve(C.dotted(node))
    body, param = fn.body, fn.params[0]
    steps = []
    if isinstance(body, ast.Call) and body.args and isinstance(body.args[0], ast.Name) and body.args[0].name == param:
        steps = [ast.Call(body.fn, body.args[1:], body.named)]
    elif isinstance(body, ast.Pipe) and isinstance(body.source, ast.Name) and body.source.name == param:
        steps = [s.call if isinstance(s.call, ast.Call) else ast.Call(s.call) for s in body.steps]
    elif isinstance(body, ast.Name) and body.name == param:
        pass
    else:
        raise PipeError("collapse: this function of rows isn't a pipe over them")
    names = [C.dotted(s.fn) for s in steps]
    row = F.struct(*[_q(c).alias(c) for c in f.columns])
    if names in (["sort", "get"], ["sort", "first"]):
        named = dict(steps[0].named)
        key, down = env.evaluate(named.get("by") or steps[0].args[0]), "dir" in named and env.evaluate(named["dir"]) == "desc"
        at = 0 if names[1] == "first" else env.evaluate(steps[1].args[0])
        if at == 0 and len(f.order) == 1 and f.order[0][1]:
            o = _q(f.order[0][0])
            if down:
                return F.max_by(row, F.struct(_q(key), -o)) if isinstance(f.data.schema[f.order[0][0]].dataType, V.INTS) else F.max_by(row, _q(key))
            return F.min_by(row, F.struct(_q(key), o))
    order = F.struct(*[_q(c).alias(f"o{i}") if up else (-_q(c)).alias(f"o{i}") for i, (c, up) in enumerate(f.order)])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("r")))), lambda x: x["r"])
    kind = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in f.kinds().items()]))
    value = V.Val(listed, kind)
    for s, title in zip(steps, names):
        value = _list_step(value, title, s, f, env)
    return value.col


def _list_step(v: V.Val, title, call, f, env) -> V.Val:
    scope = C.Scope(f, env, row=None, it=None, windows=False)
    named = dict(call.named)
    if title in ("map", "filter", "reduce", "len", "first", "last", "get", "slice"):
        return C._ROW[title](call, scope, [v])
    if title == "take":
        n = env.evaluate(call.args[0])
        return V.Val(F.slice(v.col, 1, n), v.kind) if n >= 0 else V.Val(F.slice(v.col, F.lit(1), F.greatest(F.size(v.col) + n, F.lit(0))), v.kind)
    if title == "sort":
        key, down = env.evaluate(named.get("by") or call.args[0]), "dir" in named and env.evaluate(named["dir"]) == "desc"
        pairs = F.transform(v.col, lambda x, i: F.struct(x[key].alias("k"), (-i if down else i).alias("i"), x.alias("r")))
        done = F.array_sort(pairs)
        done = F.reverse(done) if down else done
        return V.Val(F.transform(done, lambda p: p["r"]), v.kind)
    if title in ("select", "drop", "add"):
        fields = [x.name for x in v.kind.elementType.fields]
        if title == "drop":
            gone = {env.evaluate(a) for a in call.args}
            keep, new = [x for x in fields if x not in gone], {}
        elif title == "select":
            keep, new = [env.evaluate(a) for a in call.args], named
        else:
            keep, new = [x for x in fields if x not in named], named
        entries = [(x, ast.Get(ast.Name("it"), x)) for x in keep] + list(new.items())
        return C._map(ast.Call(ast.Name("map"), (ast.ObjectOf(tuple(entries)),)), scope, [v])
    if title == "collapse":
        fields = {}
        for name, node in named.items():
            agg, column = C.dotted(node.fn), C.column_of(node.args[0]) if node.args else None
            if agg == "count":
                fields[name] = V.Val(F.size(v.col).cast("bigint"), V.LONG)
                continue
            inner = next(x.dataType for x in v.kind.elementType.fields if x.name == column)
            xs = F.filter(F.transform(v.col, lambda x: x[column]), lambda x: x.isNotNull())
            reals = xs.cast("array<double>")
            total = F.aggregate(reals, F.lit(0.0), lambda a, x: a + x)
            whole = isinstance(inner, V.INTS)
            fields[name] = {
                "sum": V.Val(total.cast("bigint") if whole else total, V.LONG if whole else V.DOUBLE),
                "mean": V.Val(F.try_divide(total, F.size(xs).cast("double")), V.DOUBLE),
                "min": V.Val(F.array_min(xs), inner), "max": V.Val(F.array_max(xs), inner),
            }[agg]
        return V.array([V.struct(fields)])
    raise PipeError(f"collapse: {title} has no place in a function of rows")


def reduce(f, call, env, notes):
    """A strict left fold over the rows in order: the fold is one value, so the
    rows meet in one task; use aggregates where the function allows."""
    f = f.sequenced()
    row = F.struct(*[_q(c).alias(c) for c in f.columns])
    order = F.struct(*[_q(c).alias(f"o{i}") if up else (-_q(c)).alias(f"o{i}") for i, (c, up) in enumerate(f.order)])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("r")))), lambda x: x["r"])
    kind = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in f.kinds().items()]))
    name = f"{HIDDEN}list"
    one = f.data.agg(listed.alias(name))
    scope = C.Scope(Frame(one), env, windows=False)
    got = C._reduce(call, scope, [V.Val(F.col(name), kind)])
    return one.select(strict(got).alias("v")).first()["v"]


# -- positions -----------------------------------------------------------------------------


def _row_of(df: DataFrame, f: Frame):
    got = df.select(*[_q(c) for c in f.columns]).first()
    return None if got is None else got.asDict(recursive=True)


def first(f, call, env, notes):
    if f.within:
        return take(f, ast.Call(ast.Name("take"), (ast.Lit(1),)), env, notes)
    f = f.sequenced()
    return _row_of(f.data.orderBy(*f.order_cols()).limit(1), f)


def last(f, call, env, notes):
    f = f.sequenced()
    back = [F.col(c).desc_nulls_last() if up else F.col(c).asc_nulls_first() for c, up in f.order]
    if f.within:
        w = Window.partitionBy(*f.within).orderBy(*back)
        return f.with_data(f.data.withColumn(f"{HIDDEN}n", F.row_number().over(w)).filter(F.col(f"{HIDDEN}n") == 1).drop(f"{HIDDEN}n"))
    return _row_of(f.data.orderBy(*back).limit(1), f)


def get(f, call, env, notes):
    i = env.evaluate(_one(call, "get"))
    if f.within and i >= 0:
        g = f.indexed(f"{HIDDEN}n")
        return g.with_data(g.data.filter(F.col(f"{HIDDEN}n") == i).drop(f"{HIDDEN}n"))
    g = f.indexed(f"{HIDDEN}n")
    place = i if i >= 0 else g.data.count() + i
    got = _row_of(g.data.filter(F.col(f"{HIDDEN}n") == place), f)
    if got is None:
        raise PipeError(f"no row at {i}")
    return got


def slice_(f, call, env, notes):
    a, b = (int(env.evaluate(x)) for x in call.args)
    if a < 0 or b < 0:
        raise PipeError("slice takes no negative places")
    g = f.indexed(f"{HIDDEN}n")
    return g.with_data(g.data.filter(F.col(f"{HIDDEN}n").between(a, b)).drop(f"{HIDDEN}n"))


def length(f, call, env, notes):
    return f.data.count()


def find(f, call, env, notes):
    column, value = (env.evaluate(a) for a in call.args)
    if column not in f.columns:
        return None
    v = V.Val(_q(column), f.kinds()[column])
    f = f.sequenced()
    return _row_of(f.data.filter(V.equal(v, V.literal(value))).orderBy(*f.order_cols()).limit(1), f)


STEPS = {
    "filter": filter_, "map": map_, "mapi": mapi, "add": add, "select": select, "drop": drop, "rename": rename, "recover": recover,
    "sort": sort, "take": take, "unique": unique, "cross": cross, "flatten": flatten, "join": join, "concat": concat,
    "collapse": collapse, "reduce": reduce, "first": first, "last": last, "get": get, "slice": slice_, "len": length, "find": find,
}

ROWWISE = {"filter", "map", "add", "select", "recover"}
