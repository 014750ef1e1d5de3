"""Names that a program uses but nothing defines, told before it runs."""

from __future__ import annotations

from sluice.lang import ast

#: Names that every program knows.
KNOWN = frozenset(
    """load save print halt filter map mapi add select drop rename recover join find cross collapse sum mean count min max reduce each sort
    take unique concat flatten first last get slice set len rank rolling str int float it col Ok Err""".split()
)


def undefined_names(program: ast.Program) -> list[str]:
    """In order of appearance, without repeats. Object shorthand may name what
    isn't there, and rolling takes names of aggregates."""
    known, missing = set(KNOWN), []
    for st in program.body:
        if isinstance(st, ast.Use):
            known.add(st.alias)
            continue
        if isinstance(st, ast.Assign):
            known.add(st.name)  # a function may call itself
        if isinstance(st, ast.Namespace):
            inner = known | {a.name for a in st.body}
            used = set().union(*[ast.free_names(a.value) for a in st.body]) - inner if st.body else set()
            known.add(st.name)
        else:
            used = ast.free_names(st.value if isinstance(st, ast.Assign) else st) - known
        short = {e[0] for n in ast.walk(st) if isinstance(n, ast.ObjectOf) for e in n.entries if isinstance(e, tuple) and e[1] is None}
        missing += [n for n in sorted(used - short) if n not in missing]
    return missing
