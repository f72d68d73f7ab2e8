"""Counting engines with a plan of their own: string by string over a trie of patterns, and in a stated order of joins.

Both give the counts of the engines in counting.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import counting as C


#: Branches up to which tokens are looked for one by one; with more of them the string's substrings are looked up.
FEW = 8


class Trie:
    """Patterns by their runs of wildcards and tokens, so that those with a common beginning share the search in a string.

    A node has its branches by the run before the token (underscores, whether a `%` is in it), the token's length and the
    token, and the patterns that end there.
    """

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.root: tuple[dict, list] = ({}, [])
        self.bare: list[tuple[int, bool, int]] = []
        for number, q in enumerate(patterns):
            ops, tokens = split(q)
            if not tokens:
                self.bare.append((ops[0].count("_"), "%" in ops[0], number))
                continue
            node = self.root
            for op, token in zip(ops, tokens, strict=False):
                by_size = node[0].setdefault((op.count("_"), "%" in op), {})
                node = by_size.setdefault(len(token), {}).setdefault(token, ({}, []))
            node[1].append((ops[-1].count("_"), "%" in ops[-1], number))

    def match(self, s: str) -> list[int]:
        """Numbers of the patterns that a string matches. A branch ends where its token has no place left."""
        n = len(s)
        out = [number for under, free, number in self.bare if (n >= under if free else n == under)]
        stack: list[tuple[tuple[dict, list], list[int]]] = [(self.root, [0])]  # nodes with the ends of their last token
        while stack:
            (branches, done), ends = stack.pop()
            out += [number for under, free, number in done if (n - ends[0] >= under if free else n - under in ends)]
            for (under, free), by_size in branches.items():
                for size, children in by_size.items():
                    if not free:
                        places = [e + under for e in ends]
                    elif len(children) <= FEW:
                        for token, child in children.items():
                            at, found = s.find(token, ends[0] + under), []
                            while at >= 0:
                                found.append(at + size)
                                at = s.find(token, at + 1)
                            if found:
                                stack.append((child, found))
                        continue
                    else:
                        places = range(ends[0] + under, n - size + 1)
                    hits: dict[str, list[int]] = {}
                    for at in places:
                        if (token := s[at : at + size]) in children:
                            hits.setdefault(token, []).append(at + size)
                    stack += [(children[token], found) for token, found in hits.items()]
        return out


def split(q: str) -> tuple[list[str], list[str]]:
    """Wildcard runs around tokens, and the tokens."""
    ops, tokens, inside = [""], [], False
    for ch in q:
        if ch in "%_":
            if inside:
                ops.append("")
            ops[-1] += ch
            inside = False
        elif inside:
            tokens[-1] += ch
        else:
            tokens.append(ch)
            inside = True
    if inside:
        ops.append("")
    return ops, tokens


def narrow(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """String by string, without a join: each partition takes its strings through a trie of all patterns and sums the counts that it finds.

    The trie is sent to the tasks if the patterns are small (checked by rows and bytes); larger sets go to candidates().
    """
    p = patterns.select("pattern").distinct()
    if not C.small(p, "pattern", keyed=True):
        return C.candidates(strings, p)
    own = [r["pattern"] for r in p.orderBy("pattern").collect()]  # bounded by the check
    schema = "pattern string, w long"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, sums = Trie(own), np.zeros(len(own), np.int64)
        for b in batches:
            for s, w in zip(b["s"], b["w"], strict=True):
                sums[trie.match(s)] += w
        on = np.nonzero(sums)[0]
        if len(on):  # a frame without rows would have numbers for text, which Arrow doesn't take
            yield pd.DataFrame({"pattern": [own[k] for k in on], "w": sums[on]})

    return C._all(p, C.spread(strings.select("s", "w")).mapInPandas(walk, schema))


def _gaps(order: str, m: Column, sizes: Column) -> Column:
    """The gaps between m tokens in the order in which they are joined: forward, backward, small (the shorter lists first), or digits (gaps that aren't named come last)."""
    all_ = F.when(m > 1, F.sequence(F.lit(0), F.greatest(m - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    if order == "forward":
        return all_
    if order == "backward":
        return F.reverse(all_)
    if order == "small":
        cost = lambda g: F.get(sizes, g) + F.get(sizes, g + 1)
        return F.transform(F.array_sort(F.transform(all_, lambda g: F.struct(cost(g).alias("c"), g.alias("g")))), lambda x: x["g"])
    if not order.isdigit():
        raise ValueError(f"no order of joins: {order}")
    named = F.array(*[F.lit(int(d)) for d in dict.fromkeys(order)])
    return F.concat(F.filter(named, lambda g: g < m - 1), F.array_except(all_, named))


def ordered(strings: DataFrame, patterns: DataFrame, order: str = "small") -> DataFrame:
    """Joins the position lists of a pattern's tokens in a stated order, which may be bushy: neighbouring stretches of tokens become one, known by the places of their first and last token.

    One join by the longest token brings a pattern and a string together, which has to hold all tokens; the rest is inside
    the row, and what has no pair of places left matches nothing.
    """
    p = patterns.select("pattern").distinct().withColumn("q", P.canonical(F.col("pattern")))
    p = p.withColumn("t", P.tokens(F.col("q"))).withColumn("o", P.ops(F.col("q"))).withColumn("m", F.size("t"))
    some = p.where("m > 0")
    x = C.holders(strings, some).select("pattern", "w", "t", "o", "m", F.length("s").alias("len"), F.transform("t", lambda t: P.occurrences(F.col("s"), t)).alias("lists"))
    under = lambda op: F.length(F.replace(op, F.lit("%"), F.lit("")))
    free = lambda op: F.contains(op, F.lit("%"))
    first, last = F.get("o", F.lit(0)), F.get("o", F.col("m"))
    room = F.col("len") - F.length(F.get("t", F.col("m") - 1)) + 1 - under(last)

    def kept(list_: Column, i: Column) -> Column:
        start = F.when(i > 0, list_).when(free(first), F.filter(list_, lambda v: v > under(first))).otherwise(F.filter(list_, lambda v: v == under(first) + 1))
        return F.when(i < F.col("m") - 1, start).when(free(last), F.filter(start, lambda v: v <= room)).otherwise(F.filter(start, lambda v: v == room))

    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    x = x.withColumn("lists", F.transform("lists", kept)).where(F.forall("lists", lambda a: F.size(a) > 0))
    x = x.withColumn("gaps", _gaps(order, F.col("m"), F.transform("lists", F.size)))
    begin = F.struct(F.transform("lists", lambda a: F.transform(a, lambda v: pair(v, v))).alias("places"), F.sequence(F.lit(0), F.col("m") - 1).alias("head"))

    def step(state: Column, g: Column) -> Column:
        op, left, right = F.get("o", g + 1), F.get(state["head"], g), g + 1
        a, b = F.get(state["places"], left), F.get(state["places"], right)
        far = F.length(F.get("t", g)) + under(op)
        fits = lambda y, z: F.when(free(op), z["lo"] >= y["hi"] + far).otherwise(z["lo"] == y["hi"] + far)
        both = F.array_distinct(F.flatten(F.transform(a, lambda y: F.transform(F.filter(b, lambda z: fits(y, z)), lambda z: pair(y["lo"], z["hi"])))))
        places = F.transform(state["places"], lambda v, i: F.when(i == left, both).otherwise(v))
        return F.struct(places.alias("places"), F.transform(state["head"], lambda h: F.when(h == right, left).otherwise(h)).alias("head"))

    done = x.withColumn("end", F.aggregate("gaps", begin, step)).where(F.size(F.get(F.col("end")["places"], F.lit(0))) > 0)
    return C._all(some, done.select("pattern", "w")).unionAll(C.bare(strings, p.where("m = 0")))


