"""Cardinality estimates from samples and signatures.

The hypergeometric likelihood of k matches in a sample of m out of n records has no JVM function; it is needed for few
distinct k (at most m + 1), so those rows are worked out in a pandas function and joined.
"""

from __future__ import annotations

from math import inf, lgamma, log, pi, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import statistics as S

EPS = 1e-5


def _choose(a: int, b: int) -> float:
    return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)


def likelihood(n: int, m: int, k: int, size: int) -> float:
    """Log probability of k matches in the sample if `size` of the n records match."""
    if not k <= size <= n - m + k:
        return -inf
    return _choose(size, k) + _choose(n - size, m - k) - _choose(n, m)


def _first(low: int, high: int, good) -> int:
    """The least number in low..high for which good holds; it holds at high and from somewhere on."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid + 1, high)
    return low


def interval(n: int, m: int, k: int, eps: float = EPS) -> tuple[int, int]:
    """Least and largest number of matching records whose likelihood reaches eps; the likelihood has one peak, at k n / m."""
    peak, least = k * n // m, log(eps)
    low = _first(k, max(k, peak), lambda s: likelihood(n, m, k, s) >= least)
    top = n - m + k
    start = min(max(k, peak), top)
    high = top - _first(0, top - start, lambda d: likelihood(n, m, k, top - d) >= least)
    return low, high


def mu(n: int, m: int, k: int, eps: float = EPS) -> float:
    a, b = interval(n, m, k, eps)
    return sqrt(max(a, 1) * b)


def rho(n: int, m: int, k: int, eps: float = EPS) -> float:
    a, b = interval(n, m, k, eps)
    return sqrt(b / max(a, 1))


def zeta(n: int, m: int, most: float, eps: float = EPS) -> int:
    """Matches after which a sample of m is enough for a Q-error of `most`; 0 if even none are needed."""
    if rho(n, m, min(1, m), eps) <= most and rho(n, m, 0, eps) < most:
        return 0
    return next((k for k in range(1, m + 1) if rho(n, m, k, eps) <= most), m + 1)


def break_table(n: int, most: float, upto: int, eps: float = EPS) -> list[tuple[int, int]]:
    """Sizes (m, zeta) up to `upto` where zeta changes."""
    out: list[tuple[int, int]] = []
    for m in range(1, min(upto, n - 1) + 1):
        z = zeta(n, m, most, eps)
        if not out or out[-1][1] != z:
            out.append((m, z))
    return out


def est_m(estimates: DataFrame, n: int, m: int, eps: float = EPS) -> DataFrame:
    """pattern, k, est: the geometric middle of the interval; none counts as half a match, as in est_s."""

    def middles(batches):
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "mid": [mu(n, m, int(k), eps) if k else 0.5 for k in b["k"]]})

    mids = estimates.select("k").distinct().mapInPandas(middles, "k long, mid double")
    return estimates.select("pattern", "k").join(mids, "k").select("pattern", "k", F.col("mid").alias("est"))


def est_b(sampled: DataFrame, patterns: DataFrame, breaks: list[tuple[int, int]], n: int, eps: float = EPS) -> DataFrame:
    """pattern, m, k, est: the sample is read in order until the matches so far reach zeta. sampled: r (from 1), s."""
    table = sampled.sparkSession.createDataFrame(breaks, "at long, zeta long")  # change points: a few rows
    size = sampled.agg(F.max("r").alias("size"))
    hits = patterns.select("pattern").distinct().join(sampled, P.like("s", "pattern")).withColumn("k", F.row_number().over(W.partitionBy("pattern").orderBy("r")))
    ahead = table.withColumn("to", F.lead("at", 1, 1 << 40).over(W.orderBy("at")))
    # with k matches from record r on, the scan stops at the first size >= r whose zeta is k at most
    stop = hits.join(F.broadcast(ahead), F.col("to") > F.col("r")).where("zeta <= k").groupBy("pattern", "k", "r").agg(F.min(F.greatest("r", "at")).alias("m"))
    after = F.lead("r", 1, 1 << 40).over(W.partitionBy("pattern").orderBy("r"))
    valid = stop.withColumn("next", after).where("m < next").groupBy("pattern").agg(F.min(F.struct("m", "k")).alias("x"))
    total = hits.groupBy("pattern").agg(F.max("k").alias("all"))
    y = patterns.select("pattern").distinct().join(total, "pattern", "left").join(valid, "pattern", "left").crossJoin(F.broadcast(size))
    y = y.select("pattern", F.coalesce(F.when(F.col("x.m") <= F.col("size"), F.col("x.m")), "size").cast("long").alias("m"), F.coalesce(F.when(F.col("x.m") <= F.col("size"), F.col("x.k")), "all", F.lit(0)).cast("long").alias("k"))

    def middles(batches):
        for b in batches:
            yield b.assign(est=[mu(n, int(m), int(k), eps) if k else 0.5 * n / m for m, k in zip(b["m"], b["k"], strict=True)])

    return y.mapInPandas(middles, "pattern string, m long, k long, est double")


def parity(x: DataFrame) -> DataFrame:
    """Share of ordered pairs with different truth that the estimates order alike (a < b just where their estimates are). x: true, est.

    Pairs aren't made: how many have both the lesser truth and the lesser estimate follows from the counts of the different
    (truth, estimate) points, met point by point.
    """
    points = x.groupBy(F.col("true").alias("t"), F.col("est").alias("e")).agg(F.count("*").alias("n"))
    own = points.agg(F.array_sort(F.collect_list(F.struct("t", "e", "n"))).alias("l"), F.sum("n").alias("all"))

    def score(batches):
        for b in batches:
            for rows in b["l"]:
                yield pd.DataFrame([_alike([(r["t"], r["e"], r["n"]) for r in rows])], columns=["alike", "pairs"])

    return own.select("l").mapInPandas(score, "alike double, pairs double").select(F.try_divide("alike", "pairs").alias("parity"))


def _alike(points: list[tuple]) -> tuple[float, float]:
    """Ordered pairs with different truth that are alike, and all of them. points: (truth, estimate, rows), sorted: a tree of estimates' ranks is filled in the order of truth."""
    from itertools import groupby

    rank = {e: i + 1 for i, e in enumerate(sorted({e for _, e, _ in points}))}
    tree, total, less, pairs = [0] * (len(rank) + 1), 0, 0, 0
    ties = 0
    for _, group in groupby(points, key=lambda p: p[0]):
        group = list(group)
        for _, e, n in group:
            below, k = 0, rank[e] - 1
            while k:
                below += tree[k]
                k -= k & -k
            upto, k = 0, rank[e]
            while k:
                upto += tree[k]
                k -= k & -k
            less += n * below
            ties += n * (upto - below)
            pairs += n * total
        for _, e, n in group:
            total += n
            k = rank[e]
            while k < len(tree):
                tree[k] += n
                k += k & -k
    # each unordered pair counts for both orders: (lesser truth first) is alike if its estimate is less, the other order if it isn't less
    return float(less + less + ties), float(2 * pairs)


def union_estimate(signatures: DataFrame, parts: DataFrame, width: int) -> DataFrame:
    """pattern, n_parts, largest, similarity: how far the largest part's signature is that of all parts together.

    signatures: gram, cnt, h1..h<width>; parts: pattern, gram. The union's minima are the least ones, the
    intersection's are estimated by the greatest.
    """
    x = parts.join(signatures, "gram")
    h = [f"h{i + 1}" for i in range(width)]
    g = x.groupBy("pattern").agg(F.count("*").alias("n_parts"), F.max("cnt").alias("largest"), F.max(F.struct("cnt", *h)).alias("top"), *[F.min(k).alias(k) for k in h])
    same = sum((F.col(f"top.{k}") == F.col(k)).cast("int") for k in h)
    return g.select("pattern", "n_parts", "largest", (same / width).alias("similarity"))


def triplets(edges: DataFrame) -> DataFrame:
    """anchor, positive, negative: a node's likeliest child and that of the next node in the order of md5 (the first one's for the last). edges: parent, child, p."""
    best = edges.groupBy("parent").agg(F.max(F.struct("p", "child"))["child"].alias("positive"))
    x = S.shuffled_rank(best, "parent")
    other = x.select(F.pmod(F.col("rank") - 1, F.col("total")).alias("rank"), F.col("positive").alias("negative"))
    return x.join(other, "rank").where(F.col("total") > 1).select(F.col("parent").alias("anchor"), "positive", "negative")


def steps(edges: DataFrame) -> DataFrame:
    """node, near, p: where a walk may go from a node in one step (to children; to the parent, unless that is the root, with 1 / (children + 1)) or in two, with normalised probabilities."""
    k = edges.groupBy("parent").agg(F.count("*").alias("k"))
    up = edges.where("parent <> ''").select(F.col("child").alias("node"), F.col("parent").alias("near")).join(k.withColumnRenamed("parent", "node"), "node", "left")
    up = up.select("node", "near", (F.lit(1.0) / (F.coalesce("k", F.lit(0)) + 1)).alias("p"))
    one = edges.where("parent <> ''").select(F.col("parent").alias("node"), F.col("child").alias("near"), "p").unionAll(up)
    two = one.alias("a").join(one.alias("b"), F.col("a.near") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.near").alias("near"), (F.col("a.p") * F.col("b.p")).alias("p"))
    x = one.unionAll(two).groupBy("node", "near").agg(F.sum("p").alias("p"))
    return x.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("node")))


def drawn_triplets(edges: DataFrame, each: int = 4, seed: str = "0") -> DataFrame:
    """anchor, draw, positive, negative: for each node `each` near nodes, drawn by their probabilities, with a node that the draw's md5 picks from all.

    A weighted draw is a race: the least -ln(u) / p wins, u being the md5 of anchor, draw and candidate.
    """
    x = steps(edges).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    h = F.md5(F.concat_ws("-", F.lit(seed), "node", F.col("draw").cast("string"), "near").cast("binary"))
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 2**32
    won = x.withColumn("_t", -F.ln(u) / F.col("p")).groupBy("node", "draw").agg(F.min(F.struct("_t", "near"))["near"].alias("positive"))
    names = S.shuffled_rank(edges.select(F.col("child").alias("name")).distinct(), "name", seed)
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.lit("not"), "node", F.col("draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    total = names.agg(F.max("total").alias("total"))
    y = won.crossJoin(F.broadcast(total)).withColumn("rank", F.pmod(pick, F.col("total")))
    return y.join(names.select("rank", F.col("name").alias("negative")), "rank").select(F.col("node").alias("anchor"), "draw", "positive", "negative")


def stirling(n: float) -> float:
    """ln n! by Stirling's series with two terms of correction."""
    return 0.0 if n <= 0 else n * log(n) - n + 0.5 * log(2 * pi * n) + 1 / (12 * n) - 1 / (360 * n**3)


def likelihood_stirling(n: int, m: int, k: int, size: float) -> float:
    """The likelihood for any real size, from Stirling's series."""
    c = lambda a, b: stirling(a) - stirling(b) - stirling(a - b)
    return c(size, k) + c(n - size, m - k) - c(n, m) if k <= size <= n - m + k else -inf


def newton(f, x: float, low: float, high: float, steps: int = 60, tiny: float = 1e-9) -> float:
    """A root of f between low and high, where f changes its sign: Newton's steps with a measured slope, and halving where a step leaves the bracket."""
    a, b = f(low), f(high)
    for _ in range(steps):
        y = f(x)
        if abs(y) < tiny or high - low < tiny:
            break
        if (y < 0) == (a < 0):
            low, a = x, y
        else:
            high, b = x, y
        d = max(1e-7, 1e-7 * abs(x))
        slope = (f(min(high, x + d)) - y) / d
        nxt = x - y / slope if slope and slope == slope and abs(slope) != inf else low
        x = nxt if low < nxt < high else (low + high) / 2
    return x


def interval_smooth(n: int, m: int, k: int, eps: float = EPS) -> tuple[float, float]:
    """The interval's ends as real numbers: roots of the smooth likelihood less ln eps, on both sides of its peak."""
    g = lambda s: likelihood_stirling(n, m, k, s) - log(eps)
    bottom, top = float(k), float(n - m + k)
    peak = min(top, max(bottom, k * n / m))
    low = bottom if g(bottom) >= 0 else newton(g, (bottom + peak) / 2, bottom, peak)
    high = top if g(top) >= 0 else newton(g, (top + peak) / 2, peak, top)
    return low, high
