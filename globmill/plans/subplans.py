"""Sub-plans of a join query: the joins of all connected sets of its relations."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame


def connected(names: tuple[str, ...], joins: list[tuple[str, str, str, str]]) -> bool:
    seen = {names[0]}
    while more := {x for a, _, b, _ in joins for x in (a, b) if {a, b} <= set(names) and {a, b} & seen} - seen:
        seen |= more
    return len(seen) == len(names)


def subplans(tables: dict[str, DataFrame], filters: dict[str, Column], joins: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Name (the relations' aliases put together) -> join of the filtered relations. joins: alias, column, alias, column."""
    base = {k: df.where(filters[k]) if k in filters else df for k, df in tables.items()}
    out = {}
    for n in range(1, len(base) + 1):
        for names in combinations(base, n):
            if connected(names, joins):
                on = [(a, x, b, y) for a, x, b, y in joins if a in names and b in names]
                left, seen = base[names[0]], {names[0]}
                while len(seen) < len(names):
                    a, _, b, _ = next(j for j in on if (j[0] in seen) != (j[2] in seen))
                    new = b if a in seen else a
                    keys = [base_key(j, new) for j in on if new in (j[0], j[2]) and (j[2] if j[0] == new else j[0]) in seen]
                    left = left.join(base[new], reduce(lambda p, q: p & q, [left[o] == base[new][m] for o, m in keys]))
                    seen.add(new)
                out["".join(names)] = left
    return out


def base_key(join: tuple[str, str, str, str], new: str) -> tuple[str, str]:
    """Columns (of what is there, of the new relation)."""
    a, x, b, y = join
    return (x, y) if b == new else (y, x)
