"""Boolean rules: immutable trees of literals, And and Or, each negatable.

A rule is a value: edits give new trees. Nodes are addressed by paths (child numbers from the root). Rules compile to a
Spark Column or SQL, evaluate on NumPy matrices, and are written as text or as a postfix list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Path = tuple[int, ...]
POSTFIX = "array<struct<op:string,value:int,negated:boolean,arity:int>>"


class Rule:
    """What literals and operators share."""

    __slots__ = ()
    children: tuple[Rule, ...] = ()
    negated: bool = False

    def __len__(self) -> int:
        """Complexity: the number of nodes."""
        return 1 + sum(map(len, self.children))

    def __str__(self) -> str:
        return self.to_str()

    __repr__ = __str__

    def to_str(self, names: Mapping[int, str] | None = None, indent: int = -1) -> str:
        raise NotImplementedError

    def walk(self, path: Path = ()) -> Iterator[tuple[Path, Rule]]:
        """Each node with its path; the children of a node from right to left."""
        yield path, self
        for k in range(len(self.children) - 1, -1, -1):
            yield from self.children[k].walk((*path, k))

    def flatten(self) -> list[Rule]:
        return [node for _, node in self.walk()]

    def at(self, path: Path) -> Rule:
        return reduce(lambda node, k: node.children[k], path, self)

    def put(self, path: Path, subtree: Rule) -> Rule:
        """This tree with the node at path replaced."""
        if not path:
            return subtree
        head, *rest = path
        return replace(self, children=tuple(c.put(tuple(rest), subtree) if k == head else c for k, c in enumerate(self.children)))

    def remap(self, mapping: Mapping[int, int] | None) -> Rule:
        """This tree with other feature numbers; KeyError for one that is missing, the same tree for None."""
        return self if mapping is None else replace(self, children=tuple(c.remap(mapping) for c in self.children))

    def negate(self) -> Rule:
        return replace(self, negated=not self.negated)

    def features(self) -> set[int]:
        return {n.value for n in self.flatten() if isinstance(n, Lit)}

    def evaluate(self, data: np.ndarray) -> np.ndarray:
        """Truth of each row of a boolean matrix (rows, features)."""
        raise NotImplementedError

    def to_column(self, prefix: str = "f") -> Column:
        raise NotImplementedError

    def to_sql(self, prefix: str = "f") -> str:
        raise NotImplementedError

    def to_postfix(self) -> list[tuple[str, int | None, bool, int]]:
        """(op, value, negated, arity), operands before operators."""
        return [x for c in self.children for x in c.to_postfix()] + [(type(self).__name__.lower(), getattr(self, "value", None), self.negated, len(self.children))]


@dataclass(frozen=True, repr=False, slots=True)
class Lit(Rule):
    """Feature `value`, or its negation."""

    value: int
    negated: bool = False

    __str__ = Rule.__str__

    @property
    def children(self) -> tuple:
        return ()

    def put(self, path, subtree):
        return subtree

    def remap(self, mapping):
        return self if mapping is None else Lit(mapping[self.value], self.negated)

    def to_str(self, names=None, indent=-1):
        return "~" * self.negated + str(self.value if names is None else names[self.value])

    def evaluate(self, data):
        return data[:, self.value] != self.negated

    def to_column(self, prefix="f"):
        column = F.col(f"{prefix}{self.value}")
        return ~column if self.negated else column

    def to_sql(self, prefix="f"):
        return f"(NOT {prefix}{self.value})" if self.negated else f"{prefix}{self.value}"


@dataclass(frozen=True, repr=False, slots=True)
class Operator(Rule):
    """At least two rules, joined."""

    children: tuple[Rule, ...]
    negated: bool = False

    def __post_init__(self):
        object.__setattr__(self, "children", tuple(self.children))
        if len(self.children) < 2:
            raise ValueError("an operator needs at least two rules")

    def to_str(self, names=None, indent=-1):
        head = "~" * self.negated + type(self).__name__
        if indent < 0:
            return f"{head}({', '.join(c.to_str(names, indent) for c in self.children)})"
        lines = ",\n".join("\t" * (indent + 1) + c.to_str(names, indent + 1) for c in self.children)
        return f"{head}(\n{lines}\n" + "\t" * indent + ")"

    def evaluate(self, data):
        join = np.logical_and if isinstance(self, And) else np.logical_or
        out = self.children[0].evaluate(data)
        for c in self.children[1:]:
            out = join(out, c.evaluate(data), out=out)
        return ~out if self.negated else out

    def to_column(self, prefix="f"):
        out = reduce(and_ if isinstance(self, And) else or_, [c.to_column(prefix) for c in self.children])
        return ~out if self.negated else out

    def to_sql(self, prefix="f"):
        word = " AND " if isinstance(self, And) else " OR "
        inner = f"({word.join(c.to_sql(prefix) for c in self.children)})"
        return f"(NOT {inner})" if self.negated else inner


class And(Operator):
    __slots__ = ()


class Or(Operator):
    __slots__ = ()


OPERATORS = (Or, And)


def is_operator(rule: Rule) -> bool:
    return isinstance(rule, Operator)


def is_operator_type(kind: type) -> bool:
    return isinstance(kind, type) and issubclass(kind, Operator) and kind is not Operator


def parse(text: str) -> Rule:
    """The rule that to_str() wrote with feature numbers."""
    tokens = re.findall(r"~|And|Or|\d+|[(),]", text)
    at = 0

    def node() -> Rule:
        nonlocal at
        negated = tokens[at] == "~"
        at += negated
        token = tokens[at]
        at += 1
        if token.isdigit():
            return Lit(int(token), negated)
        kind, children = {"And": And, "Or": Or}[token], []
        while tokens[at] in "(,":
            at += 1
            children.append(node())
        at += 1
        return kind(tuple(children), negated)

    rule = node()
    if at != len(tokens):
        raise ValueError(f"not a rule: {text}")
    return rule


def from_postfix(items) -> Rule:
    stack: list[Rule] = []
    for op, value, negated, arity in items:
        if op == "lit":
            stack.append(Lit(value, negated))
        else:
            children = tuple(stack[len(stack) - arity :])
            del stack[len(stack) - arity :]
            stack.append({"and": And, "or": Or}[op](children, negated))
    (rule,) = stack
    return rule


def pick_node(rule: Rule, rng: np.random.Generator, operator_p: float = 0.9) -> Path:
    """The path of a random node: an operator with probability operator_p if there is one, else a literal; any of its kind alike."""
    inner = [p for p, n in rule.walk() if is_operator(n)]
    if inner and rng.random() < operator_p:
        return inner[rng.integers(len(inner))]
    leaves = [p for p, n in rule.walk() if not is_operator(n)]
    return leaves[rng.integers(len(leaves))]


def swap(a: Rule, at_a: Path, b: Rule, at_b: Path) -> tuple[Rule, Rule]:
    """Both trees with the nodes at their paths exchanged."""
    return a.put(at_a, b.at(at_b)), b.put(at_b, a.at(at_a))


def complexity_check(most: int = 100):
    """A predicate for rules of at most `most` nodes."""
    if isinstance(most, bool) or not isinstance(most, int) or most < 1:
        raise ValueError("the complexity limit must be a positive int")
    return lambda rule: len(rule) <= most
