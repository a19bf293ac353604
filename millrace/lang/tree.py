"""The typed tree that the parser and the builder make and the plans read."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: str | int | float | bool | None
    text: str = ""  # as written, for decimals


@dataclass(frozen=True)
class Param(Node):
    name: str


@dataclass(frozen=True)
class Name(Node):
    parts: tuple[str, ...]
    place: tuple[int, int] = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None


@dataclass(frozen=True)
class Sort(Node):
    of: Node
    descending: bool = False


@dataclass(frozen=True)
class Over(Node):
    partition: tuple[Node, ...] = ()
    order: tuple[Sort, ...] = ()


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    distinct: bool = False
    over: Over | None = None
    place: tuple[int, int] = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class Binary(Node):
    """Arithmetic, ``||``, comparisons and like."""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Negative(Node):
    of: Node


@dataclass(frozen=True)
class Junction(Node):
    op: str  # and, or
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    of: Node


@dataclass(frozen=True)
class IsNull(Node):
    of: Node
    negated: bool = False


@dataclass(frozen=True)
class Among(Node):
    of: Node
    items: tuple[Node, ...]


@dataclass(frozen=True)
class AmongRows(Node):
    of: Node
    rows: Pipeline


@dataclass(frozen=True)
class Exists(Node):
    rows: Pipeline


@dataclass(frozen=True)
class Between(Node):
    of: Node
    low: Node
    high: Node


@dataclass(frozen=True)
class Case(Node):
    whens: tuple[tuple[Node, Node], ...]
    otherwise: Node | None = None


@dataclass(frozen=True)
class Lambda(Node):
    names: tuple[str, ...]
    body: Node


@dataclass(frozen=True)
class Aliased(Node):
    of: Node
    alias: str


@dataclass(frozen=True)
class Named(Node):
    name: str
    value: Node


@dataclass(frozen=True)
class Step(Node):
    name: str
    args: tuple[Node, ...]
    place: tuple[int, int] = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class Pipeline(Node):
    """source: a Name (table or let), a Call (row generator) or a Pipeline."""

    source: Node
    steps: tuple[Step, ...] = ()


@dataclass(frozen=True)
class Program(Node):
    lets: tuple[tuple[str, Pipeline], ...]
    result: Pipeline
    text: str = field(default="", compare=False)
