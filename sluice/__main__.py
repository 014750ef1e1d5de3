"""python -m sluice FILE [--cache FOLDER] runs a program; without a file it reads
statements from the terminal. A failed program ends with status 1."""

from __future__ import annotations

import argparse
import os
import sys

from sluice.lang.parser import SyntaxFault, parse
from sluice.plans.frame import Err
from sluice.plans.interpreter import Interpreter, run_file
from sluice.plans.values import PipeError
from sluice.runtime import session


def complete(text: str) -> bool:
    """Whether the statements typed so far can be run."""
    opened = sum(text.count(c) for c in "([{") - sum(text.count(c) for c in ")]}")
    return opened <= 0 and not text.rstrip().endswith(("|>", "->", "=", ",", "\\"))


def repl(run: Interpreter, lines, out=sys.stdout) -> None:
    held = ""
    for line in lines:
        held += line
        if line.strip() and not complete(held):
            continue
        if held.strip():
            try:
                parse(held)
                got = run.run(held)
                if got is not None:
                    run.show(got, out)
            except (SyntaxFault, PipeError) as bad:
                print(f"error: {bad}", file=out)
        held = ""


def read_variables(path: str = ".env") -> None:
    """Environment variables from lines KEY=VALUE; those already set stay."""
    if os.path.isfile(path):
        with open(path) as src:
            for line in src:
                key, eq, value = line.strip().partition("=")
                if eq and key and not key.startswith("#"):
                    os.environ.setdefault(key.removeprefix("export ").strip(), value.strip().strip("\"'"))


def main(argv=None) -> int:
    read_variables()
    args = argparse.ArgumentParser(prog="sluice")
    args.add_argument("file", nargs="?")
    args.add_argument("--cache")
    known = args.parse_args(argv)
    spark = session()
    if not known.file:
        repl(Interpreter(spark, cache_dir=known.cache), sys.stdin)
        return 0
    try:
        got = run_file(spark, known.file, known.cache)
    except (SyntaxFault, PipeError, OSError) as bad:
        print(f"error: {bad}", file=sys.stderr)
        return 1
    if isinstance(got, Err):
        print(f"error: {got.msg}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
