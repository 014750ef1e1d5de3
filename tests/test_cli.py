import io

from sluice.__main__ import complete, main, repl
from sluice.lang.parser import parse
from sluice.lang.validate import undefined_names
from sluice.plans.interpreter import LIBRARIES, Interpreter


def test_undefined_names():
    source = "use math\nf = x -> x + y\nf(z)\nns n {\n  a = q\n}\n[{v: 1}] |> add(w: math.log(it.v), r: rolling(col.v, 2, mean)) |> each(by: \"v\", g -> g |> take(1))\n{shorthand}"
    assert undefined_names(parse(source)) == ["y", "z", "q"]


def test_repl_reads_on_until_a_statement_is_whole(spark):
    out = io.StringIO()
    repl(Interpreter(spark, LIBRARIES), ["x = 2\n", "x + 1\n", "[1, 2]\n", "nope\n", "f(\n", "x)\n"], out)
    assert out.getvalue().splitlines()[:2] == ["2", "3"] and "error: undefined name: nope" in out.getvalue()
    assert complete("a |> b()") and not complete("a |>") and not complete("f(1,")


def test_files_end_with_a_status(spark, tmp_path):
    good, bad, broken = (tmp_path / n for n in ("a", "b", "c"))
    good.write_text("[{v: 1}] |> filter(it.v > 0) |> print()\n")
    bad.write_text('load("/no/such.csv") |> take(1)\n')
    broken.write_text("1 +\n")
    assert [main([str(f)]) for f in (good, bad, broken)] == [0, 1, 1]
