"""Predicates by the type of their column, bits of them over sampled rows, and conditions between places."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def like_plain_underscore(s: Column, q: Column) -> Column:
    """LIKE where `_` is a character like any other: only `%` is a wildcard."""
    literal = F.replace(F.replace(q, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("%"), F.lit("\\E.*\\Q"))
    return F.regexp_like(s, F.concat(F.lit("(?s)^\\Q"), literal, F.lit("\\E\\z")))


#: Operators of one column and one literal.
COMPARE = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
}


def test(df: DataFrame, column: str, op: str, value=None) -> Column:
    """One predicate as a Column that is never null (null rows aren't selected, but by IS NULL).

    Ops: =, !=, <, <=, >, >=, LIKE, NOT LIKE, IN, IS NULL, IS NOT NULL. The literal is read as the column's type.
    """
    c, kind = F.col(column), df.schema[column].dataType
    cast = lambda v: F.lit(v).cast(kind)
    op = op.upper()
    if op in ("IS NULL", "IS NOT NULL"):
        return c.isNull() if op == "IS NULL" else c.isNotNull()
    if op in ("LIKE", "NOT LIKE"):
        if not isinstance(kind, T.StringType):
            raise TypeError(f"{op} needs text, {column} is {kind.simpleString()}")
        hit = c.like(str(value).replace("\\", "\\\\"))
        out = hit if op == "LIKE" else ~hit
    elif op == "IN":
        out = c.isin(*[cast(v) for v in value]) if value else F.lit(False)
    else:
        out = COMPARE[op](c, cast(value))
    return F.coalesce(out, F.lit(False))


def tree(df: DataFrame, node) -> Column:
    """A tree of predicates: (column, op, value), or ("AND" / "OR", parts), or ("NOT", part)."""
    if node[0] in ("AND", "OR") and isinstance(node[1], (list, tuple)) and not isinstance(node[1], str):
        return reduce((lambda a, b: a & b) if node[0] == "AND" else (lambda a, b: a | b), [tree(df, n) for n in node[1]])
    return ~tree(df, node[1]) if node[0] == "NOT" else test(df, *node)


@dataclass(frozen=True)
class Condition:
    """A condition that a pattern puts on places: a prefix's first token, a suffix's last one, or two neighbours.

    `number` is the least distance; with `open` (a `%` between) the distance may be greater.
    """

    kind: str  # prefix, suffix or substring
    number: int
    open: bool

    def distance(self, places: Column, other: Column | None = None, length: Column | None = None) -> Column:
        """prefix: the place; suffix: characters from it to the string's end; substring: from one place to the other."""
        return {"prefix": lambda: places, "suffix": lambda: length - places, "substring": lambda: other - places}[self.kind]()

    def holds(self, *args, **named) -> Column:
        d = self.distance(*args, **named)
        return d >= self.number if self.open else d == self.number


def conditions_of(q: str) -> list[Condition]:
    """The conditions of a pattern, from left to right: place of the first token (from 1), gaps, room behind the last token's place."""
    from .engines import split

    ops, tokens = split(q)
    if not tokens:
        return []
    under, free = [o.count("_") for o in ops], ["%" in o for o in ops]
    out = [Condition("prefix", under[0] + 1, free[0])]
    out += [Condition("substring", len(t) + under[i + 1], free[i + 1]) for i, t in enumerate(tokens[:-1])]
    return [*out, Condition("suffix", len(tokens[-1]) + under[-1] - 1, free[-1])]
