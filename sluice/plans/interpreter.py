"""Programs of the pipe language: driver values here, table steps in Spark."""

from __future__ import annotations

import importlib.util
import inspect
import os
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import driver as D
from sluice.functions import ml, viz
from sluice.lang import ast
from sluice.lang.parser import SyntaxFault, parse, parse_expression
from sluice.plans import compiler as C
from sluice.plans import steps as S
from sluice.plans.cache import Store
from sluice.plans.frame import HIDDEN, Err, Frame, Ok, as_frame
from sluice.plans.values import PipeError
from sluice.runtime import materialize, shared_folder
from sluice.sources import io

LIBRARIES = ("math", "text", "ml", "viz", "env")


class Library:
    def __init__(self, name):
        self.name = name

    def member(self, name):
        if self.name == "env":
            return D.variable(name)
        raise KeyError(name)


class Module:
    """A namespace of driver values."""

    def __init__(self, values: dict):
        self.values = values

    def member(self, name):
        if name not in self.values:
            raise PipeError(f"no member {name}")
        return self.values[name]


class Env:
    def __init__(self, run, parent=None, values=None):
        self.run, self.parent, self.values = run, parent, dict(values or {})

    def get(self, name):
        e = self
        while e is not None:
            if name in e.values:
                return e.values[name]
            e = e.parent
        raise KeyError(name)

    def set(self, name, value):
        self.values[name] = value

    def child(self, values=None):
        return Env(self.run, self, values)

    def resolve(self, title):
        """The driver value of a name or name.member, or None."""
        if title is None:
            return None
        head, _, tail = title.partition(".")
        try:
            value = self.get(head)
            if tail:
                if isinstance(value, Module):
                    return value.member(tail)
                return value.get(tail) if isinstance(value, dict) else None
            return value
        except (KeyError, PipeError):
            return None

    def library(self, head):
        try:
            value = self.get(head)
        except KeyError:
            return None
        return value.name if isinstance(value, Library) else None

    def evaluate(self, node):
        return self.run.value(node, self)


class Tail(Exception):
    """Not raised: marks a call in tail position for the trampoline."""

    def __init__(self, fn, args):
        self.fn, self.args = fn, args


class Interpreter:
    """Runs programs on a session. ``libraries``: those known without ``use``."""

    def __init__(self, spark, libraries=(), cache_dir: str | None = None, quiet: bool = True, out=None):
        self.spark, self.quiet, self.out = spark, quiet, out
        self.store = Store(cache_dir) if cache_dir else None
        self.globals = Env(self, values={n: Library(n) for n in libraries})

    # -- programs --
    def run(self, source: str):
        """The last statement's value; an Err where a pipe failed."""
        return self.program(parse(source), self.globals)

    def program(self, program, env):
        out = None
        for st in program.body:
            out = self.statement(st, env)
        return out

    def statement(self, st, env):
        if isinstance(st, ast.Assign):
            if isinstance(st.value, (ast.Call, ast.Binary, ast.Text, ast.Match, ast.Get, ast.Unary)) and C.mentions_it(st.value):
                value = C.Macro(st.value, env, st.notes)
            else:
                value = self.value(st.value, env)
            if isinstance(value, C.Closure) and not value.name:
                value.name = st.name
            env.set(st.name, value)
            return value
        if isinstance(st, ast.Use):
            return self.use(st, env)
        if isinstance(st, ast.Namespace):
            inner = env.child()
            for a in st.body:
                self.statement(a, inner)
            env.set(st.name, Module(inner.values))
            return None
        return self.value(st, env)

    def use(self, st, env):
        if not st.is_path:
            if st.what not in LIBRARIES:
                raise PipeError(f"no library {st.what}")
            env.set(st.alias, Library(st.what))
            return None
        path = Path(st.what)
        if path.suffix == ".py":
            env.set(st.alias, Module(python_module(path)))
        else:
            inner = Env(self, self.globals)
            self.program(parse(path.read_text()), inner)
            env.set(st.alias, Module(inner.values))
        return None

    # -- expressions --
    def value(self, node, env):
        return self.ev(node, env, False)

    def ev(self, n, env, tail):
        kind = type(n)
        if kind is ast.Lit:
            return n.value
        if kind is ast.Name:
            try:
                return env.get(n.name)
            except KeyError:
                if n.name in D.CORE or n.name in S.STEPS or n.name in ("load", "each"):
                    return D.Builtin(n.name)
                raise PipeError(f"undefined name: {n.name}") from None
        if kind is ast.Text:
            return "".join(p if isinstance(p, str) else D.shown(self.value(p, env), none="") for p in n.parts)
        if kind is ast.ListOf:
            out = []
            for i in n.items:
                if isinstance(i, ast.Spread):
                    out.extend(D.listed(self.value(i.value, env)))
                else:
                    out.append(self.value(i, env))
            return out
        if kind is ast.ObjectOf:
            out = {}
            for e in n.entries:
                if isinstance(e, ast.Spread):
                    out |= self.value(e.value, env)
                elif e[1] is not None:
                    out[e[0]] = self.value(e[1], env)
                else:
                    try:
                        out[e[0]] = env.get(e[0])
                    except KeyError:
                        out[e[0]] = True
            return out
        if kind is ast.RangeOf:
            a, b = self.value(n.low, env), self.value(n.high, env)
            return range(a, b + 1)
        if kind is ast.Get:
            return self.get_field(n, env)
        if kind is ast.At:
            value = self.value(n.value, env)
            if isinstance(n.key, ast.RangeOf):
                return self.builtin("slice", [value, self.value(n.key.low, env), self.value(n.key.high, env)], {}, env)
            return self.builtin("get", [value, self.value(n.key, env)], {}, env)
        if kind is ast.Binary:
            if n.op in ("and", "or"):
                left = self.value(n.left, env)
                return (self.ev(n.right, env, tail) if D.true(left) else left) if n.op == "and" else (left if D.true(left) else self.ev(n.right, env, tail))
            return D.binary(n.op, self.value(n.left, env), self.value(n.right, env))
        if kind is ast.Unary:
            v = self.value(n.value, env)
            return D.negative(v) if n.op == "-" else not D.true(v)
        if kind is ast.Match:
            return self.match(n, env, tail)
        if kind is ast.Lambda:
            return C.Closure(n.params, n.body, env)
        if kind is ast.Block:
            inner, out = env.child(), None
            for i, st in enumerate(n.body):
                last = i == len(n.body) - 1
                out = self.ev(st, inner, tail) if last and not isinstance(st, ast.Assign) else self.statement(st, inner)
            return out
        if kind is ast.Assign:
            return self.statement(n, env)
        if kind is ast.Call:
            return self.call(n, env, tail)
        if kind is ast.Pipe:
            return self.pipe(self.value(n.source, env), n.steps, env)
        if kind is Held:
            return n.held
        raise PipeError(f"{kind.__name__} has no value here")

    def get_field(self, n, env):
        if isinstance(n.value, ast.Name) and n.value.name == "col":
            try:
                env.get("col")
            except KeyError:
                return C.ast.Get(n.value, n.field)
        value = self.value(n.value, env)
        value = value.value if isinstance(value, Ok) else value
        if isinstance(value, Frame):
            if n.field == "data":
                return replace(value, errors=None, artifacts={})
            if n.field == "errors":
                return Frame(value.errors) if value.errors is not None else []
            if n.field in value.artifacts:
                return value.artifacts[n.field]
            raise PipeError(f"no field {n.field}; there are data, errors{''.join(', ' + a for a in value.artifacts)}")
        if isinstance(value, dict):
            if n.field not in value:
                raise PipeError(f"no field {n.field}")
            return value[n.field]
        if isinstance(value, (Module, Library)):
            try:
                return value.member(n.field)
            except KeyError:
                return D.Builtin(f"{value.name}.{n.field}")
        raise PipeError(f"{D.kind(value)} has no field {n.field}")

    def match(self, n, env, tail):
        subject = self.value(n.subject, env)
        if any(a.op in ("Ok", "Err") for a in n.arms):
            subject = self.settle(subject)
        for a in n.arms:
            if a.op == "_":
                return self.ev(a.result, env, tail)
            if a.op in ("Ok", "Err"):
                if isinstance(subject, Err) == (a.op == "Err"):
                    inner = subject.msg if a.op == "Err" else subject.value if isinstance(subject, Ok) else subject
                    return self.ev(a.result, env.child({a.value: inner}), tail)
                continue
            if D.true(D.binary(a.op, subject, self.value(a.value, env))):
                return self.ev(a.result, env, tail)
        return Err("no match")

    def settle(self, value):
        """Tables are lazy: run one, so that what its rows do wrong shows now."""
        if isinstance(value, Frame):
            try:
                value.data.write.format("noop").mode("overwrite").save()
            except PySparkException as bad:
                return Err(message(bad), bad)
        return value

    # -- calls --
    def call(self, n, env, tail):
        title = C.dotted(n.fn)
        fn = env.resolve(title) if title else None
        if fn is None and title is not None:
            head, _, short = title.partition(".")
            lib = env.library(head) if short else None
            if lib:
                return self.library_call(lib, short, n, None, env)
            if title in S.STEPS or title in D.CORE or title in ("load", "each"):
                return self.step_call(title, n, None, env, ())
            fn = self.value(n.fn, env)
        elif fn is None:
            fn = self.value(n.fn, env)
        args = [self.value(a, env) for a in n.args]
        named = {k: self.value(v, env) for k, v in n.named}
        return self.apply(fn, args, named, env, tail)

    def apply(self, fn, args, named, env, tail=False):
        if isinstance(fn, D.Builtin):
            return self.builtin(fn.name, args, named, env)
        if isinstance(fn, C.RowFunction):
            return fn.fn(*[D.plain(a) for a in args], **named)
        if callable(fn) and not isinstance(fn, C.Closure):
            try:
                return fn(*[D.plain(a) for a in args], **named)
            except Exception as bad:
                return Err(f"{type(bad).__name__}: {bad}", bad)
        if not isinstance(fn, C.Closure):
            raise PipeError(f"{D.kind(fn)} can't be called")
        if tail:
            return Tail(fn, args)
        while True:
            if len(args) != len(fn.params):
                raise PipeError(f"{fn.name or 'function'} takes {len(fn.params)} arguments, not {len(args)}")
            got = self.ev(fn.body, fn.env.child(dict(zip(fn.params, args))), True)
            if not isinstance(got, Tail):
                return got
            fn, args = got.fn, got.args

    def pipe(self, value, steps, env):
        for s in steps:
            value = value.value if isinstance(value, Ok) else value
            if isinstance(value, Err):
                return value
            call = s.call if isinstance(s.call, ast.Call) else ast.Call(s.call)
            title = C.dotted(call.fn) or "step"
            try:
                before, value = value, self.step(title, call, value, env, s.notes)
                if not self.quiet and not s.quiet and isinstance(value, Frame):
                    print(self.summary(title, before, value), file=sys.stderr)
            except (PipeError, SyntaxFault, PySparkException, ValueError, TypeError, KeyError, ArithmeticError, IndexError, OSError) as bad:
                return Err(f"{title}: {message(bad)}", bad)
        return value

    def summary(self, title, before, after) -> str:
        """One line on a step, from its schema and the cache alone: counting rows
        would be a job of its own, which @progress asks for."""
        text = f"|> {title:<12} {len(after.columns)} cols"
        known = before.columns if isinstance(before, Frame) else list(before[0]) if isinstance(before, list) and before and isinstance(before[0], dict) else None
        if known is not None:
            text += "".join(f" +{c}" for c in after.columns if c not in known) + "".join(f" -{c}" for c in known if c not in after.columns)
            if after.errors is not getattr(before, "errors", None):
                text += " (errors kept apart)"
        if self.store is not None and self.store.hits:
            text += f" [{self.store.hits} cached]"
        return text

    def step(self, title, call, value, env, notes):
        names = {n for n, _, _ in notes}
        if "progress" in names:  # asked for: one count when the step's rows are there
            got = self.step(title, call, value, env, tuple(n for n in notes if n[0] != "progress"))
            if isinstance(got, Frame):
                bad = 0 if got.errors is None else got.errors.count()
                print(f"{title}: {got.data.count()} rows, {bad} errors", file=sys.stderr)
            return got
        if names & {"concurrent", "retry", "row_cache"} and title not in S.ROWWISE and env.resolve(title) is None and not title.startswith("ml."):
            raise PipeError(f"only row-wise steps take @{sorted(names)[0]}")
        if self.store is not None and names & {"cache", "row_cache"} and not isinstance(value, Frame):
            value = as_frame(self.spark, value)
        if self.store is not None and isinstance(value, Frame):
            if "cache" in names:
                key = self.store.step_key(call, notes, value, env)
                got = self.store.load_step(key, value)
                if got is not None:
                    self.store.hits += 1
                    return got
                self.store.misses += 1
                got = self.step_call(title, call, value, env, notes)
                if isinstance(got, Frame) and (got.errors is None or got.errors.isEmpty()):
                    got = self.store.save_step(key, got)
                return got
            if "row_cache" in names:
                got, run, cached = self.store.rows(call, value, lambda f: self.step_call(title, call, f, env, notes), env)
                self.store.hits, self.store.misses = cached, run
                return got
        return self.step_call(title, call, value, env, notes)

    def step_call(self, title, call, value, env, notes):
        """One call, ``value`` being what is piped in (None: nothing)."""
        fn = env.resolve(title)
        if isinstance(fn, TableFunction) and value is not None:
            value = as_frame(self.spark, value)
        if isinstance(fn, (C.Closure, C.RowFunction)) or (fn is not None and callable(fn)):
            args = ([] if value is None else [value]) + [self.value(a, env) for a in call.args]
            return self.apply(fn, args, {k: self.value(v, env) for k, v in call.named}, env)
        head, _, short = title.partition(".")
        lib = env.library(head) if short else None
        if lib:
            return self.library_call(lib, short, call, value, env)
        args = list(call.args)
        if title == "load":
            named = {k: self.value(v, env) for k, v in call.named}
            try:
                return io.load(self.spark, self.value(args[0], env) if args else value, **named)
            except PipeError as bad:
                return Err(str(bad), bad)
        if value is None:
            if not args:
                if title in D.CORE or title in C.AGGREGATES:
                    return D.Builtin(title)
                raise PipeError(f"{title} needs a value")
            value = self.value(args.pop(0), env)
            call = ast.Call(call.fn, tuple(args), call.named)
        value = value.value if isinstance(value, Ok) else value
        if isinstance(value, Err):
            return value
        table = isinstance(value, (Frame, DataFrame)) or (isinstance(value, (list, tuple)) and value and all(isinstance(r, dict) for r in value))
        if table and title == "concat":
            others = [self.value(a, env) for a in args]
            return S.concat_frames([as_frame(self.spark, x) for x in (value, *others)])
        if table and title == "get" and not isinstance(value, Frame):
            return self.builtin(title, [value, *[self.value(a, env) for a in args]], {}, env)
        if table and title in S.STEPS:
            flat = {}
            for name, a, named in notes:
                flat[name] = [self.value(x, env) for x in a]
            return S.STEPS[title](as_frame(self.spark, value), call, env, flat)
        if table and title == "each":
            return self.each(as_frame(self.spark, value), call, env)
        if table and title == "save":
            f = as_frame(self.spark, value)
            io.save(f, self.value(args[0], env), **{k: self.value(v, env) for k, v in call.named})
            return value
        if title == "print":
            self.show(value)
            return value
        if title == "halt":
            D.echo(D.shown(value) if value is not None else "halted", sys.stderr)
            sys.exit(1)
        return self.plain_step(title, value, call, env)

    def show(self, value, out=None):
        """Print a value; of a table all rows in order, a partition at a time."""
        out = out or self.out
        if isinstance(value, (Frame, DataFrame)):
            for r in as_frame(self.spark, value).visible().toLocalIterator():
                D.echo(D.shown(r.asDict(recursive=True)), out)
        else:
            D.echo(D.shown(value), out)

    # -- driver lists --
    def plain_step(self, title, value, call, env):
        if title in ("map", "filter", "mapi"):
            body = call.args[0]
            fn = self.item_function(body, env)
            items = D.listed(value)
            if title == "mapi":
                return [fn({"idx": i, "val": x}) for i, x in enumerate(items)]
            return [fn(x) for x in items] if title == "map" else [x for x in items if D.true(fn(x))]
        args = [self.value(a, env) for a in call.args]
        named = {k: self.value(v, env) for k, v in call.named}
        return self.builtin(title, [value, *args], named, env)

    def item_function(self, node, env):
        title = C.dotted(node)
        fn = env.resolve(title) if title and title != "it" else None
        if fn is None and title and title.partition(".")[2] and env.library(title.partition(".")[0]):
            fn = self.value(node, env)
        if isinstance(node, ast.Lambda):
            fn = self.value(node, env)
        if fn is not None and not isinstance(fn, (int, float, str, list, dict)):
            return lambda x: self.apply(fn, [x], {}, env)
        return lambda x: self.value(node, env.child({"it": x}))

    def builtin(self, name, args, named, env):
        lib, _, short = name.partition(".")
        if short:
            return D.call(lib, short, args, named)
        if args and isinstance(args[0], (Frame, DataFrame)):
            f = as_frame(self.spark, args[0])
            call = ast.Call(ast.Name(name), tuple(Held(a) for a in args[1:]), tuple((k, Held(v)) for k, v in named.items()))
            return self.step_call(name, call, f, env, ())
        if name == "reduce":
            acc = args[1]
            for x in D.listed(args[0]):
                acc = self.apply(args[2], [acc, x], {}, env)
            return acc
        if name == "print":
            self.show(args[0])
            return args[0]
        if name not in D.CORE:
            raise PipeError(f"undefined name: {name}")
        return D.CORE[name](*args, **named)

    # -- libraries --
    def library_call(self, lib, short, call, value, env):
        args = [self.value(a, env) for a in call.args]
        named = {k: self.value(v, env) for k, v in call.named}
        if lib in ("math", "text", "env"):
            return D.call(lib, short, ([] if value is None else [value]) + args, named)
        if lib == "viz" or short in ("kmeans", "ols", "umap", "silhouette"):
            f = as_frame(self.spark, value if value is not None else args.pop(0))
            if lib == "viz":
                return f.with_artifact("viz", {"plot": viz.step(short, f, dict(zip(("x", "y"), args)) | named)})
            if short == "silhouette":
                score = ml.silhouette(f, *args, **named)
                D.echo(f"silhouette: {score:.4f}", self.out)
                return f
            if isinstance(named.get("k"), range):
                named["k"] = list(named["k"])
            return getattr(ml, short)(f, *args, **named)
        if short == "dist":
            return D.distance(*([] if value is None else [value]), *args, **named)
        if short in ("embed", "llm"):
            fn = ml.PROVIDERS[short].get(named.get("source"))
            if fn is None:
                raise PipeError(f"ml.{short}: no provider {named.get('source')!r} is registered; use ml.provide")
            return fn(*([] if value is None else [value]), *args, named)
        raise PipeError(f"{lib} has no function {short}")

    # -- groups --
    def each(self, f, call, env):
        named = dict(call.named)
        by = C.keys_of(named.get("by"), C.row_scope(f, env))
        body = call.args[-1]
        if isinstance(body, ast.Lambda):
            inner = body.body
            if isinstance(inner, ast.Pipe) and isinstance(inner.source, ast.Name) and inner.source.name == body.params[0]:
                steps = inner.steps
            else:
                steps = None
        else:
            steps = body.steps
        for k in by:
            if k not in f.columns:
                raise PipeError(f"each: no field {k}")
        if steps is not None and all(C.dotted(s.call.fn if isinstance(s.call, ast.Call) else s.call) in PUSHED for s in steps):
            return self.each_pushed(f, by, steps, env)
        return self.each_driven(f, by, body, env)

    def each_pushed(self, f, by, steps, env):
        """All groups at once: every step partitions by hidden copies of the keys."""
        outer = f
        f = f.kept()
        secret = [f"{HIDDEN}each{len(f.within) + i}" for i in range(len(by))]
        data = f.data.withColumns({h: F.col(f"`{k}`") for h, k in zip(secret, by)})
        lead = []
        if f.order and len(f.order) == 1:  # groups come in the order of their first rows
            h, up = f"{HIDDEN}lead{len(f.within)}", f.order[0]
            w = C.Window.partitionBy(*f.within, *secret)
            first = F.min(up[0]) if up[1] else F.max(up[0])
            data = data.withColumn(h, first.over(w))
            lead = [(h, up[1])]
        elif not f.ordered and not f.order:
            lead = [(h, True) for h in secret]
        g = Frame(data, f.order, None, {}, f.ordered, (*f.within, *secret))
        for s in steps:
            c = s.call if isinstance(s.call, ast.Call) else ast.Call(s.call)
            got = self.step_call(C.dotted(c.fn), c, g, env, s.notes)
            if isinstance(got, Err):
                return got
            g = got
        back = [(k, h) for k, h in zip(by, secret) if k not in g.columns]
        data = g.data
        if lead and lead[0][0] not in data.columns:  # an aggregate took the place of the rows
            firsts = f.data.withColumns({h: F.col(f"`{k}`") for h, k in zip(secret, by)}).groupBy(*secret).agg(
                (F.min(f.order[0][0]) if f.order[0][1] else F.max(f.order[0][0])).alias(lead[0][0])
            )
            pairs = firsts.select(*[F.col(h).alias(f"{h}_") for h in secret], lead[0][0])
            cond = [data[h].eqNullSafe(pairs[f"{h}_"]) for h in secret]
            data = data.join(pairs, cond, "left").drop(*[f"{h}_" for h in secret])
        data = data.withColumns({k: F.col(h) for k, h in back})
        keys = [k for k, _ in back]
        names = keys + [c for c in data.columns if c not in keys]
        data = data.select(*[F.col(f"`{c}`") for c in names])
        order = [o for o in (*lead, *g.order) if o[0] in data.columns]
        errors = outer.add_errors(g.errors)
        return Frame(data, tuple(dict.fromkeys(order)), errors, {**outer.artifacts, **g.artifacts}, outer.ordered, outer.within)

    def each_driven(self, f, by, body, env):
        """Steps that can't be pushed down (models, side effects): one group
        after another, as each may run jobs of its own."""
        f = f.kept()
        first = F.min(f.order[0][0]) if f.order and f.order[0][1] else F.max(f.order[0][0]) if f.order else F.lit(0)
        counted = f.data.groupBy(*[F.col(f"`{k}`") for k in by]).agg(first.alias(f"{HIDDEN}first"))
        turn = F.col(f"{HIDDEN}first").asc() if not f.order or f.order[0][1] else F.col(f"{HIDDEN}first").desc()
        tables, artifacts = [], {}
        for r in (tuple(g)[:-1] for g in materialize(counted).orderBy(turn, *by).toLocalIterator()):
            part = f.data
            for k, v in zip(by, r):
                part = part.filter(F.col(f"`{k}`").eqNullSafe(F.lit(v)))
            g = Frame(part, f.order, None, {}, f.ordered)
            got = self.apply(self.value(body, env), [g], {}, env) if isinstance(body, ast.Lambda) else self.pipe(g, body.steps, env)
            if isinstance(got, Err):
                return got
            if isinstance(got, list) and got and all(isinstance(x, dict) for x in got):
                got = as_frame(self.spark, got)
            if not isinstance(got, Frame) or got is g:  # a side effect: the table stays as it was
                tables = None
                continue
            for name, a in got.artifacts.items():
                artifacts.setdefault(name, {})[r[0] if len(by) == 1 else r] = a
            for k, v in zip(by, r):
                if k not in got.columns:
                    got = got.with_data(got.data.withColumn(k, F.lit(v)))
            if tables is not None:
                tables.append(got)
        if not tables:
            return f
        out = S.concat_frames(tables)
        errors = f.errors
        for t in tables:
            errors = Frame(f.data, errors=errors).add_errors(t.errors)
        return replace(out, errors=errors, artifacts={**f.artifacts, **artifacts})


#: Steps that each can run for all groups at once.
PUSHED = {
    "filter", "add", "select", "drop", "rename", "sort", "take", "unique", "cross", "flatten", "collapse", "first", "last", "map", "mapi",
    "slice", "join",
}


class Held(ast.Node):
    """A driver value where a call wants a node."""

    def __init__(self, value):
        object.__setattr__(self, "held", value)


def message(bad) -> str:
    text = str(bad)
    if isinstance(bad, PySparkException):
        text = bad.getMessage() if hasattr(bad, "getMessage") and bad.getMessage() else text
    text = text.replace("[USER_RAISED_EXCEPTION] ", "").replace(" SQLSTATE: P0001", "")
    return text.splitlines()[0][:500] if text else type(bad).__name__


def python_module(path: Path) -> dict:
    """The public functions of a Python file. Functions whose first parameter is
    annotated as a DataFrame work on tables; others are called per row."""
    spec = importlib.util.spec_from_file_location(path.stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(module) if path.stem in sys.modules else None
    out = {}
    for name, fn in vars(module).items():
        if name.startswith("_") or not inspect.isfunction(fn) or fn.__module__ != path.stem:
            continue
        first = next(iter(inspect.signature(fn).parameters.values()), None)
        hint = str(first.annotation) if first is not None else ""
        out[name] = TableFunction(fn) if "DataFrame" in hint else row_function(fn)
    return out


def alone(fn: C.Closure):
    """A function of the language as a Python function that tasks can run: with
    the functions and plain values it names, and without the session."""
    seen: dict[int, str] = {}
    held: dict[str, tuple] = {}

    def keep(closure, name):
        seen[id(closure)] = name
        values = {}
        for free in sorted(ast.free_names(closure.body) - set(closure.params)):
            env = closure.env.env if isinstance(closure.env, C.Scope) else closure.env
            try:
                value = env.get(free)
            except KeyError:
                continue
            if isinstance(value, C.Closure):
                if id(value) not in seen:
                    keep(value, f"{free}{len(seen)}")
                values[free] = ("fn", seen[id(value)])
            elif isinstance(value, Library):
                values[free] = ("library", value.name)
            elif isinstance(value, (C.RowFunction, Frame, DataFrame, Module)):
                if isinstance(value, C.RowFunction):
                    values[free] = ("value", value.fn)
            else:
                values[free] = ("value", value)
        held[name] = (closure.params, closure.body, values, closure.name)

    keep(fn, "0")
    made: dict[str, C.Closure] = {}

    def call(*args):
        run = Interpreter(None, LIBRARIES)
        if not made:
            for name, (params, body, _, title) in held.items():
                made[name] = C.Closure(params, body, None, title)
            for name, (_, _, values, _) in held.items():
                bound = {k: made[v] if kind == "fn" else Library(v) if kind == "library" else v for k, (kind, v) in values.items()}
                made[name].env = run.globals.child(bound)
        got = run.apply(made["0"], list(args), {}, run.globals)
        if isinstance(got, Err):
            raise PipeError(got.msg)
        return got.value if isinstance(got, Ok) else got

    return call


class TableFunction:
    """DataFrame in, DataFrame out."""

    def __init__(self, fn):
        self.fn = fn

    def __call__(self, table, *args, **named):
        df = table.visible() if isinstance(table, Frame) else table
        got = self.fn(df, *args, **named)
        return Frame(got, ordered=False) if isinstance(got, DataFrame) else got


def row_function(fn, kind=None, **settings):
    """A Python function as a row function; its type from the annotation of its
    result (int, float, bool, str, list[float], list[str]), else text."""
    from pyspark.sql import types as T

    known = {
        int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType(), "int": T.LongType(), "float": T.DoubleType(),
        "bool": T.BooleanType(), "str": T.StringType(), list[float]: T.ArrayType(T.DoubleType()), list[str]: T.ArrayType(T.StringType()),
        "list[float]": T.ArrayType(T.DoubleType()), "list[str]": T.ArrayType(T.StringType()),
    }
    told = inspect.signature(fn).return_annotation if kind is None else kind
    if not isinstance(told, T.DataType):
        told = known.get(told, T.StringType())
    return C.RowFunction(fn, told, **settings)


class Table:
    """The fluent face of the language: the same steps as methods. Expressions
    are given as text of the language, other arguments as plain values."""

    def __init__(self, frame: Frame | DataFrame | list, run: Interpreter | None = None, spark=None):
        if run is None:
            spark = spark or (frame.sparkSession if isinstance(frame, DataFrame) else frame.data.sparkSession if isinstance(frame, Frame) else None)
            run = Interpreter(spark, LIBRARIES)
        self.run = run
        self.frame = frame if isinstance(frame, Err) else as_frame(run.spark, frame)

    EXPRESSIONS = {"filter": 0, "map": 0, "mapi": 0}

    def _call(self, title, *args, notes=(), **named):
        nodes = []
        for i, a in enumerate(args):
            nodes.append(parse_expression(a) if isinstance(a, str) and self.EXPRESSIONS.get(title) == i else _node(a))
        pairs = []
        for k, v in named.items():
            as_text = isinstance(v, str) and title in ("add", "select", "recover", "collapse") and k != "by"
            pairs.append((k, parse_expression(v) if as_text else _node(v)))
        fn = ast.Name(title) if "." not in title else ast.Get(ast.Name(title.split(".")[0]), title.split(".")[1])
        step = ast.Step(ast.Call(fn, tuple(nodes), tuple(pairs)), True, tuple((n, tuple(_node(x) for x in a), ()) for n, a in notes))
        got = self.run.pipe(self.frame, (step,), self.run.globals)
        if isinstance(got, Err):
            raise PipeError(got.msg)
        return Table(got, self.run) if isinstance(got, (Frame, DataFrame)) else got

    def __getattr__(self, title):
        if title.startswith("_"):
            raise AttributeError(title)
        return lambda *a, **k: self._call(title, *a, **k)

    def ml(self, title, **named):
        return self._call(f"ml.{title}", **named)

    def each(self, by, pipe: str):
        """``pipe``: the sub-pipe as text, such as "|> sort(by: \\"x\\") |> take(2)"."""
        call = parse_expression(f"each(by: by_keys, {pipe})")
        got = self.run.step_call("each", call, self.frame, self.run.globals.child({"by_keys": by}), ())
        if isinstance(got, Err):
            raise PipeError(got.msg)
        return Table(got, self.run)

    @property
    def df(self) -> DataFrame:
        """The rows without hidden columns, in no particular order."""
        return self.frame.unordered()

    @property
    def errors(self) -> DataFrame | None:
        return self.frame.errors

    @property
    def artifacts(self) -> dict:
        return self.frame.artifacts

    def rows(self):
        return self.frame.rows()


def _node(value):
    if isinstance(value, Table):
        return Held(value.frame)
    if isinstance(value, ast.Node):
        return value
    return ast.Lit(value) if value is None or isinstance(value, (str, int, float, bool)) else Held(value)


def table(source, spark=None, order_by=None) -> Table:
    """A fluent table from a DataFrame, a list of objects or a path."""
    from pyspark.sql import SparkSession

    spark = spark or (source.sparkSession if isinstance(source, DataFrame) else SparkSession.getActiveSession())
    if isinstance(source, str):
        source = io.load(spark, source, order_by)
    elif isinstance(source, DataFrame) and order_by:
        data = source
        for i, c in enumerate(order_by):
            data = data.withColumn(f"{HIDDEN}k{i}", F.col(f"`{c}`"))
        source = Frame(data, tuple((f"{HIDDEN}k{i}", True) for i in range(len(order_by))))
    return Table(source, Interpreter(spark, LIBRARIES))


def run_file(spark, path: str, cache: str | None = None) -> object:
    """Run a program file; its front matter may name cache_dir, quiet, cache."""
    text = Path(path).read_text()
    settings: dict[str, str] = {}
    if text.startswith("---"):
        head, _, text = text[3:].partition("\n---")
        for line in head.splitlines():
            key, colon, value = line.partition(":")
            if colon:
                settings[key.strip()] = value.strip().strip('"')
    folder = cache or settings.get("cache_dir")
    if not folder and settings.get("cache") == "true":  # beside the program, or where the executors find it too
        local = spark.sparkContext.master.startswith("local")
        folder = os.path.join(os.path.dirname(path) or ".", ".cache") if local else f"{shared_folder(spark)}/sluice-cache"
    return Interpreter(spark, cache_dir=folder, quiet=settings.get("quiet") == "true").run(text)
