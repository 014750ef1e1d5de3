"""Syntax tree of the pipe language. Nodes carry no positions, so that
``canonical`` gives equal text for equal meaning wherever it stands."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: object


@dataclass(frozen=True)
class Name(Node):
    name: str


@dataclass(frozen=True)
class Text(Node):
    """An interpolated string: strings and expressions."""

    parts: tuple


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple


@dataclass(frozen=True)
class Spread(Node):
    value: Node


@dataclass(frozen=True)
class ObjectOf(Node):
    """Entries are (key, node), a Spread, or (key, None) for shorthand."""

    entries: tuple


@dataclass(frozen=True)
class RangeOf(Node):
    low: Node
    high: Node


@dataclass(frozen=True)
class Get(Node):
    """``value.field``"""

    value: Node
    field: str


@dataclass(frozen=True)
class At(Node):
    """``value[key]``; a RangeOf key slices."""

    value: Node
    key: Node


@dataclass(frozen=True)
class Call(Node):
    fn: Node
    args: tuple = ()
    named: tuple = ()  # (name, node) pairs


@dataclass(frozen=True)
class Lambda(Node):
    params: tuple
    body: Node


@dataclass(frozen=True)
class Step(Node):
    call: Node
    quiet: bool = False
    notes: tuple = ()  # (name, args, named)


@dataclass(frozen=True)
class Pipe(Node):
    source: Node | None  # None: a sub-pipe given as an argument
    steps: tuple


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    value: Node


@dataclass(frozen=True)
class Arm(Node):
    """``op`` is a comparison, ``_``, ``Ok`` or ``Err``; for the last two
    ``value`` is the bound name."""

    op: str
    value: object
    result: Node


@dataclass(frozen=True)
class Match(Node):
    subject: Node
    arms: tuple


@dataclass(frozen=True)
class Block(Node):
    body: tuple


@dataclass(frozen=True)
class Assign(Node):
    name: str
    value: Node
    notes: tuple = ()


@dataclass(frozen=True)
class Use(Node):
    what: str
    is_path: bool
    alias: str


@dataclass(frozen=True)
class Namespace(Node):
    name: str
    body: tuple


@dataclass(frozen=True)
class Program(Node):
    body: tuple = field(default=())


def walk(node):
    """All nodes under ``node``, itself first."""
    if isinstance(node, Node):
        yield node
        for f in fields(node):
            yield from walk(getattr(node, f.name))
    elif isinstance(node, tuple):
        for x in node:
            yield from walk(x)


def canonical(node) -> str:
    if isinstance(node, Node):
        return f"{type(node).__name__}({', '.join(canonical(getattr(node, f.name)) for f in fields(node))})"
    if isinstance(node, tuple):
        return f"({', '.join(canonical(x) for x in node)})"
    return repr(node)


def free_names(node, bound: frozenset = frozenset()) -> set[str]:
    """Names a node uses that it doesn't bind itself."""
    if isinstance(node, Name):
        return set() if node.name in bound else {node.name}
    if isinstance(node, Lambda):
        return free_names(node.body, bound | set(node.params))
    if isinstance(node, Block):
        out: set[str] = set()
        for s in node.body:
            out |= free_names(s, bound)
            if isinstance(s, Assign):
                bound = bound | {s.name}
        return out
    if isinstance(node, Arm):
        inner = bound | {node.value} if node.op in ("Ok", "Err") else bound
        out = free_names(node.result, inner)
        return out | (free_names(node.value, bound) if isinstance(node.value, Node) else set())
    if isinstance(node, ObjectOf):
        out = set()
        for e in node.entries:
            if isinstance(e, Spread):
                out |= free_names(e.value, bound)
            elif e[1] is None:
                out |= set() if e[0] in bound else {e[0]}
            else:
                out |= free_names(e[1], bound)
        return out
    out = set()
    if isinstance(node, Node):
        for f in fields(node):
            out |= free_names(getattr(node, f.name), bound)
    elif isinstance(node, tuple):
        for x in node:
            out |= free_names(x, bound)
    return out
