import math

import pytest

from sluice.plans.frame import Err, Frame
from sluice.plans.interpreter import LIBRARIES, Interpreter, row_function
from sluice.plans.values import PipeError


@pytest.fixture
def run(spark):
    def go(source, **names):
        i = Interpreter(spark, LIBRARIES)
        for k, v in names.items():
            i.globals.set(k, v)
        got = i.run(source)
        return got.rows() if isinstance(got, Frame) else got

    return go


@pytest.fixture
def frame(spark):
    def go(source, **names):
        i = Interpreter(spark, LIBRARIES)
        for k, v in names.items():
            i.globals.set(k, v)
        return i.run(source)

    return go


@pytest.mark.parametrize(
    "source, value",
    [
        ("1 + 2 * 3", 7), ("7 / 2", 3.5), ("-7 % 3", 2), ("7 % -3", -2), ('"a" + "b"', "ab"), ("not 0", True), ("none == none", True), ("1 == true", True),
        ("fact = n -> match(n, 0: 1, _: n * fact(n - 1))\nfact(10)", 3628800), ("loop = (n, a) -> match(n, 0: a, _: loop(n - 1, a + 1))\nloop(20000, 0)", 20000),
        ("add = x -> y -> x + y\nadd(1)(2)", 3), ("[1,2,3] |> map(it * 2) |> filter(it > 2)", [4, 6]), ("[1,2,3] |> reduce(0, (a, x) -> a + x)", 6),
        ("[5,6] |> mapi(it.idx + it.val)", [5, 7]), ("1..3 |> map(x -> x + 1)", [2, 3, 4]), ("[1,2,3][-1]", 3), ("[1,2,3,4][1..2]", [2, 3]),
        ("len([1,2])", 2), ("first([])", None), ("set([1,2], 1, 9)", [1, 9]), ('concat([1], [2, 3])', [1, 2, 3]), ('name = "bo"\n"hi {name}, {1 + 1}"', "hi bo, 2"),
        ("(a = 1; b = 2; a + b)", 3), ("{a: 1, ...{b: 2}}", {"a": 1, "b": 2}), ("x = 1\n{x, y}", {"x": 1, "y": True}), ("int(3.9)", 3), ("int(none)", None),
        ("str(true)", "True"), ('match("b", "a": 1, "b": 2)', 2), ("match(5, > 10: 1, > 3: 2, _: 3)", 2), ("math.round(2.5)", 2), ('text.slice("hello", -3)', "llo"),
        ("ns n {\n  f = x -> x * 3\n}\nn.f(2)", 6), ("[3,1,2] |> sort()", [1, 2, 3]), ("[1,1,2] |> unique()", [1, 2]), ("true and 5", 5), ("0 or 7", 7),
    ],
)
def test_driver_values(run, source, value):
    assert run(source) == value


def test_errors_short_circuit(run):
    got = run('load("/no/such.csv") |> filter(it.a > 1) |> take(1)')
    assert isinstance(got, Err) and "such" in got.msg
    assert run('r = load("/no/such.csv") |> take(1)\nmatch(r, Ok(d): "fine", Err(m): "bad")') == "bad"
    assert run('match(math.log(-1), Ok(v): v, Err(m): "no")') == "no"
    assert isinstance(run("[1, 2] |> map(it / 0)"), Err)


def test_row_errors_and_recover(frame):
    f = frame("[{v: 5}, {v: 0}, {v: none}] |> add(q: 10 / it.v)")
    assert f.rows() == [{"v": 5, "q": 2.0}]
    bad = f.error_rows()
    assert [(r["v"], r["_step"]) for r in bad] == [(0, "add(q)"), (None, "add(q)")] and all(r["_error"] for r in bad)
    f = frame("[{v: 5}, {v: 0}] |> add(q: 10 / it.v) |> recover(q: -1.0)")
    assert [(r["v"], r["q"]) for r in f.rows()] == [(5, 2.0), (0, -1.0)] and f.rows()[1]["_step"] == "add(q)" and not f.error_rows()
    f = frame("[{v: 5}, {v: 0}] |> add(q: 10 / it.v) |> recover(q: 1 / it.v)")
    assert len(f.rows()) == 1 and len(f.error_rows()) == 1


def test_failing_filter_fails_the_pipe(run):
    assert run('r = [{v: 1}, {v: none}] |> filter(it.v > 0)\nmatch(r, Ok(d): 1, Err(m): 2)') == 2
    assert run("[{v: 1}, {v: none}] |> filter(it.v != none)") == [{"v": 1}]


def test_projection(run):
    assert run('[{a: 1, b: 2, c: 3}] |> select("c", "zz", d: it.a + it.b)') == [{"c": 3, "d": 3}]
    assert run('[{a: 1, b: 2}] |> drop("b", "zz")') == [{"a": 1}]
    assert run('[{a: 1, b: 2}] |> rename(a: "x")') == [{"x": 1, "b": 2}]
    assert isinstance(run('[{a: 1}] |> rename(b: "x")'), Err)
    assert run("[{a: 1}] |> add(a: it.a + 1, b: it.a)") == [{"a": 2, "b": 1}]  # independent of each other
    assert run("[{a: 1}] |> map({...it, b: 2})") == [{"a": 1, "b": 2}]
    assert run("f = x -> x * 2\n[{v: 4}] |> add(w: f(it.v)) |> filter(row -> row.w > 3)") == [{"v": 4, "w": 8}]
    assert run('k = "v"\n[{v: 4}] |> add(w: it[k] + 1)') == [{"v": 4, "w": 5}]
    assert run('[{v: 3}] |> add(l: "{it.v}-{it.v + 1}", m: match(it.v, > 2: "hi", _: "lo"))') == [{"v": 3, "l": "3-4", "m": "hi"}]
    assert run("[{t: [1, 2, 3]}] |> add(u: it.t |> map(it * 2), n: len(it.t), s: it.t[0..1], r: reduce(it.t, 0, (a, x) -> a + x))")[0] == {
        "t": [1, 2, 3], "u": [2, 4, 6], "n": 3, "s": [1, 2], "r": 6,
    }


def test_order_sensitive_steps(run):
    t = '[{v: 3, i: 1}, {v: 1, i: 2}, {v: 3, i: 3}, {v: 2, i: 4}]'
    ids = lambda rows: [r["i"] for r in rows]
    assert ids(run(t + ' |> sort(by: "v")')) == [2, 4, 1, 3]
    assert ids(run(t + ' |> sort(by: "v", dir: "desc")')) == [1, 3, 4, 2]
    assert ids(run(t + " |> take(2)")) == [1, 2] and ids(run(t + " |> take(-1)")) == [1, 2, 3]
    assert ids(run(t + ' |> unique(by: "v")')) == [1, 2, 4]
    assert ids(run(t + " |> slice(1, 2)")) == [2, 3]
    assert run(t + " |> get(-1)")["i"] == 4 and run(t + " |> first()")["i"] == 1 and run(t + " |> last()")["i"] == 4
    assert run(f"x = {t}\nx[1]")["i"] == 2
    assert run(t + " |> mapi({k: it.idx, i: it.val.i})")[2] == {"k": 2, "i": 3}
    assert run(t + " |> reduce(0, (a, x) -> a + x.v)") == 9
    assert isinstance(run('[{v: 1}] |> get(4)'), Err)


def test_joins_and_lookups(run):
    left = '[{k: "a", v: 1}, {k: none, v: 2}, {k: "z", v: 3}]'
    right = '[{k: "a", v: 10}, {k: "a", v: 20}, {k: none, v: 30}]'
    assert run(f'{left} |> join({right}, on: "k")') == [{"k": "a", "v": 20}, {"k": None, "v": 30}]
    assert run(f't = {right}\n[{{x: "a"}}] |> add(y: find(t, "k", it.x).v)') == [{"x": "a", "y": 10}]
    assert run(f'find({right}, "v", 20)') == {"k": "a", "v": 20} and run(f'find({right}, "v", 99)') is None
    assert run('[{m: "x"}, {m: "y"}] |> cross("n", [1, 2])') == [{"m": "x", "n": 1}, {"m": "x", "n": 2}, {"m": "y", "n": 1}, {"m": "y", "n": 2}]
    assert run('[{id: 1, t: ["x"]}, {id: 2, t: []}] |> flatten("t")') == [{"id": 1, "value": "x"}]
    assert run('[{id: 1, t: [{v: 1}, {v: 2}]}] |> flatten("t")') == [{"id": 1, "v": 1}, {"id": 1, "v": 2}]
    assert run("concat([{a: 1}], [{a: 2, b: 3}])") == [{"a": 1, "b": None}, {"a": 2, "b": 3}]


def test_aggregates(run):
    t = '[{g: "b", v: 1}, {g: "a", v: 3}, {g: "b", v: 5}, {g: none, v: 7}, {g: "a", v: none}]'
    assert run(t + ' |> collapse(by: "g", s: sum(col.v), n: count(), m: mean(col.v), lo: min(col.v), hi: max(it.v), k: 5)') == [
        {"g": "a", "s": 3, "n": 2, "m": 3.0, "lo": 3, "hi": 3, "k": 5}, {"g": "b", "s": 6, "n": 2, "m": 3.0, "lo": 1, "hi": 5, "k": 5},
    ]
    assert run(t + " |> collapse(s: sum(col.v), n: count())") == [{"s": 16, "n": 5}]
    assert isinstance(run(t + " |> collapse(s: sum(col.nope))"), Err)
    u = '[{g: "a", v: 1}, {g: "a", v: 3}, {g: "b", v: 5}]'
    got = run(u + ' |> collapse(by: "g", top: rows -> rows |> sort(by: "v", dir: "desc") |> get(0), vs: rows -> rows |> map(it.v), two: rows -> rows |> take(1), n: rows -> len(rows))')
    assert got[0] == {"g": "a", "top": {"g": "a", "v": 3}, "vs": [1, 3], "two": [{"g": "a", "v": 1}], "n": 2}
    got = run(u + ' |> collapse(by: "g", s: rows -> rows |> filter(it.v > 1) |> collapse(n: count(), s: sum(col.v)))')
    assert got[0]["s"] == [{"n": 1, "s": 3}]
    assert run("[{v: [1.0, 2.0]}, {v: [3.0, 4.0]}] |> collapse(m: mean(col.v), s: sum(col.v))") == [{"m": [2.0, 3.0], "s": [4.0, 6.0]}]


def test_windows(run):
    t = '[{g: "a", v: 1}, {g: "a", v: 3}, {g: "b", v: 3}]'
    got = run(t + ' |> add(r: rank(col.v, dir: "desc"), q: rank(col.v, by: "g"), m: mean(col.v, by: "g"), t: sum(col.v), n: count(by: "g"), up: it.v > mean(col.v, by: "g"))')
    assert [(r["r"], r["q"], r["m"], r["t"], r["n"], r["up"]) for r in got] == [(3, 1, 2.0, 7, 2, False), (1, 2, 2.0, 7, 2, True), (1, 1, 3.0, 7, 1, False)]
    got = run('[{v: 1}, {v: 2}, {v: 6}] |> add(r: rolling(col.v, 2, mean), c: rolling(col.v, 2, count), s: rolling(col.v, 3, "sum"))')
    assert [(r["r"], r["c"], r["s"]) for r in got] == [(None, None, None), (1.5, 2.0, None), (4.0, 2.0, 9.0)]
    assert run('r = [{v: none}, {v: 1}] |> add(r: rank(col.v))\nmatch(r, Ok(x): 1, Err(m): 2)') == 2


def test_each(run):
    t = '[{g: "b", v: 1}, {g: none, v: 4}, {g: "b", v: 3}, {g: "a", v: 5}]'
    assert run(t + ' |> each(by: "g", |> sort(by: "v", dir: "desc") |> take(1))') == [{"g": "b", "v": 3}, {"g": None, "v": 4}, {"g": "a", "v": 5}]
    assert run(t + ' |> each(by: "g", g -> g |> collapse(s: sum(col.v)))') == [{"g": "b", "s": 4}, {"g": None, "s": 4}, {"g": "a", "s": 5}]
    got = run(t + ' |> each(by: "g", |> add(r: rank(col.v), m: mean(col.v)) |> filter(it.r == 1))')
    assert [(r["g"], r["v"], r["m"]) for r in got] == [("b", 1, 2.0), (None, 4, 4.0), ("a", 5, 5.0)]
    assert run(t + ' |> each(by: "g", g -> print(g))') == run(t)


def test_nan_and_null_rules(run):
    nan = math.nan
    assert run("t |> filter(it.v == it.v)", t=[{"v": nan}, {"v": 1.0}, {"v": None}]) == [{"v": 1.0}, {"v": None}]
    assert run("t |> filter(it.v > 0)", t=[{"v": nan}, {"v": 1.0}]) == [{"v": 1.0}]
    assert run("t |> collapse(m: mean(col.v), s: sum(col.v), n: count())", t=[{"v": nan}, {"v": 1.0}]) == [{"m": 1.0, "s": 1.0, "n": 2}]
    assert run('t |> filter(it.s)', t=[{"s": ""}, {"s": "x"}, {"s": None}]) == [{"s": "x"}]
    got = run('t |> add(a: str(it.v), b: "{it.v}", c: int(it.v))', t=[{"v": 1e16}, {"v": None}, {"v": nan}, {"v": 2.5}])
    assert [(r["a"], r["b"], r["c"]) for r in got] == [("1e+16", "1e+16", 10**16), ("None", "", None), ("nan", "nan", None), ("2.5", "2.5", 2)]


def test_modulo_follows_the_divisor(run):
    rows = [{"a": a, "b": b} for a in (-7, 7, 0) for b in (3, -3)]
    assert [r["m"] for r in run("t |> add(m: it.a % it.b)", t=rows)] == [r["a"] % r["b"] for r in rows]
    reals = [{"a": float(a), "b": b + 0.5} for a in (-7, 7) for b in (3, -3)]
    assert [r["m"] for r in run("t |> add(m: it.a % it.b)", t=reals)] == pytest.approx([r["a"] % r["b"] for r in reals])


def test_library_functions_agree_on_rows_and_driver(run):
    calls = [
        'math.log(it.x)', 'math.sqrt(it.x)', 'math.pow(it.x, 2)', 'math.floor(it.x)', 'math.ceil(it.x)', 'math.round(it.x)', 'math.abs(it.x)',
        'math.clamp(it.x, 0.0, 2.0)', 'math.mean(it.l)', 'math.median(it.l)', 'math.std(it.l)', 'math.min(it.l)', 'math.max(it.l)', 'math.sum(it.l)',
        'text.trim(it.s)', 'text.upper(it.s)', 'text.lower(it.s)', 'text.replace(it.s, "b", "c")', 'text.split(it.s, "b")', 'text.split(it.s)',
        'text.contains(it.s, "b")', 'text.starts_with(it.s, " ")', 'text.ends_with(it.s, "x")', 'text.length(it.s)', 'text.match(it.s, "[ab]+")',
        'text.slice(it.s, 1, 3)', 'text.slice(it.s, -2)', 'text.at(it.s, 1)', 'text.ord("é")', 'text.char(8364)', 'text.chars(it.s)', 'text.join(it.l, "-")',
        'ml.dist(it.l, it.l)', 'ml.dist(it.l, [1.0, 1.0, 1.0], metric: "euclidean")',
    ]
    row = {"x": 2.5, "l": [1.0, 2.0, 4.0], "s": " aB b \n"}
    for c in calls:
        here = run(f"t |> map({c})", t=[row])
        there = run(c, it=row)
        assert here[0]["value"] == pytest.approx(there) if isinstance(there, float) else here[0]["value"] == there, c


def test_python_functions_with_annotations(spark, tmp_path):
    module = tmp_path / "helpers.py"
    module.write_text("def twice(n: int) -> int:\n    if n == 3:\n        raise ValueError('three')\n    return n * 2\n\ndef _hidden():\n    pass\n")
    i = Interpreter(spark, LIBRARIES)
    f = i.run(f'use "{module}" as h\n[{{n: 1}}, {{n: 3}}] |> add(m: h.twice(it.n)) @concurrent(2) @retry(1)')
    assert f.rows() == [{"n": 1, "m": 2}] and "three" in f.error_rows()[0]["_error"]
    assert i.run("h.twice(4)") == 8
    assert isinstance(i.run("[{n: 1}] |> sort(by: \"n\") @retry(2)"), Err)


def test_retry_calls_again(spark, tmp_path):
    marks = str(tmp_path)

    def flaky(n: int) -> int:
        import os

        path = f"{marks}/{n}"
        if not os.path.exists(path):
            open(path, "w").close()
            raise RuntimeError("once")
        return n

    i = Interpreter(spark, LIBRARIES)
    i.globals.set("flaky", row_function(flaky))
    assert i.run("[{n: 1}, {n: 2}] |> add(m: flaky(it.n)) @retry(1)").rows() == [{"n": 1, "m": 1}, {"n": 2, "m": 2}]


def test_use_of_programs_and_undefined_names(spark, tmp_path):
    (tmp_path / "t.flow").write_text("clean = d -> d |> filter(it.v > 1)\n")
    i = Interpreter(spark)
    assert i.run(f'use "{tmp_path}/t.flow" as t\n[{{v: 1}}, {{v: 2}}] |> t.clean()').rows() == [{"v": 2}]
    with pytest.raises(PipeError):
        i.run("nope + 1")
    assert isinstance(i.run("[{v: 1}] |> add(w: it.zz)"), Err)


def test_reals_as_text_follow_the_language(run):
    values = [0.0, -0.0, 1.5, 123456.789, 1e7, 12345678.5, 1e15, 1e16, 1e22, 1e-4, 0.00012, 1e-5, -2.5e-7, 1e100, 1e-100, math.inf, -math.inf]
    assert [r["t"] for r in run("t |> add(t: str(it.v))", t=[{"v": v} for v in values])] == [str(v) for v in values]


def test_progress_and_quiet_steps(spark, capsys):
    i = Interpreter(spark, LIBRARIES, quiet=False)
    i.run("[{v: 1}, {v: 0}] |> add(w: 1 / it.v) @progress\n[{v: 1}] |> take(1) quiet")
    err = capsys.readouterr().err
    assert "add: 1 rows, 1 errors" in err and "take" not in err
