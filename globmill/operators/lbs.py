"""Estimates from min-hash signatures of masked n-grams, with Markov chains for parts that are longer than a gram.

Hash values are compared directly: their order among all records is that of their ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import statistics as S

PRIME = 2**31 - 1


def signatures(records: DataFrame, n: int, a: list[int], b: list[int], least: int = 1) -> DataFrame:
    """kind (sub, pre, suf), gram, cnt, h1 .. hL of masked grams of up to n characters that at least `least` records hold. records: rid, s."""
    size = F.length("s")
    x = records.select("rid", F.coalesce("s", F.lit("")).alias("s")).where(size > 0)
    x = x.withColumn("at", F.explode(F.sequence(F.lit(1), size))).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), size - F.col("at") + 1))))
    sides = F.filter(F.array(F.lit("sub"), F.when(F.col("at") == 1, "pre"), F.when(F.col("at") + F.col("n") == size + 1, "suf")), lambda k: k.isNotNull())
    x = x.select("rid", sides.alias("kinds"), F.explode(S._masks(F.substr("s", "at", "n"))).alias("gram")).select("rid", "gram", F.explode("kinds").alias("kind"))
    # a minimum is the same with repeated rows; only the count needs distinct records, so repeats go before the shuffle's second half
    x = x.distinct().groupBy("kind", "gram")
    return x.agg(F.count("*").alias("cnt"), *[F.min(F.pmod(F.col("rid") * p + q, F.lit(PRIME))).alias(f"h{i + 1}") for i, (p, q) in enumerate(zip(a, b, strict=True))]).where(F.col("cnt") >= least)


def parts(patterns: DataFrame) -> DataFrame:
    """pattern, i, part, kind: runs between `%` with underscores as masks. The first part of a prefix pattern is `pre`, the last one of a suffix pattern `suf`; parts of exact patterns count as `sub`."""
    q = F.replace(P.canonical(F.col("pattern"), True), F.lit("_"), F.lit(S.ANY))
    left, right = q.startswith("%"), q.endswith("%")
    x = patterns.select("pattern").distinct().select("pattern", (~left & right).alias("p"), (left & ~right).alias("s"), F.filter(F.split(q, "%+"), lambda b: b != "").alias("bs"))
    x = x.select("pattern", "p", "s", F.size("bs").alias("k"), F.posexplode("bs").alias("i", "part"))
    return x.select("pattern", "i", "part", F.when(F.col("p") & (F.col("i") == 0), "pre").when(F.col("s") & (F.col("i") == F.col("k") - 1), "suf").otherwise("sub").alias("kind"))


def part_signatures(parts: DataFrame, table: DataFrame, n: int, width: int) -> DataFrame:
    """Adds card and h1 .. hL of each part: its gram's, or a chain over its windows of n characters with the greatest hashes. 0 if a window is unknown."""
    h = [f"h{i + 1}" for i in range(width)]
    last = F.greatest(F.lit(1), F.length("part") - n + 1)
    w = parts.withColumn("last", last).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("last")))).withColumn("gram", F.substr("part", "at", F.lit(n)))
    edge = ((F.col("kind") == "pre") & (F.col("at") == 1)) | ((F.col("kind") == "suf") & (F.col("at") == F.col("last")))
    w = w.withColumn("side", F.when(edge, F.col("kind")).otherwise("sub")).withColumn("before", F.when(F.col("at") > 1, F.substr("part", "at", F.lit(n - 1))))
    w = w.join(table.withColumnRenamed("kind", "side"), ["side", "gram"], "left")
    w = w.join(table.where("kind = 'sub'").select(F.col("gram").alias("before"), F.col("cnt").alias("base")), "before", "left")
    known = F.count("cnt") == F.count("*")
    chain = F.exp(F.sum(F.ln("cnt")) - F.sum(F.when(F.col("at") > 1, F.ln(F.coalesce("base", "cnt"))).otherwise(0.0)))
    whole = F.when(F.count("*") == 1, F.max("cnt").cast("double")).otherwise(F.greatest(chain, F.lit(1e-6)))
    return w.groupBy("pattern", "i", "part", "kind").agg(F.when(known, whole).otherwise(0.0).alias("card"), *[F.when(known, F.max(k)).alias(k) for k in h])


def estimate(patterns: DataFrame, table: DataFrame, total: int, n: int, width: int, coverage: float = 1.0) -> DataFrame:
    """pattern, n_parts, est: union times intersection share of the parts, at most the rarest part; all records for wildcards alone."""
    h = [f"h{i + 1}" for i in range(width)]
    x = part_signatures(parts(patterns), table, n, width)
    g = x.groupBy("pattern").agg(F.count("*").alias("n_parts"), F.min("card").alias("low"), F.max("card").alias("high"), F.max(F.struct("card", *h)).alias("top"), *[y for k in h for y in (F.min(k).alias(f"u{k}"), F.max(k).alias(f"i{k}"))])
    share = lambda test: sum(F.coalesce(test(k).cast("int"), F.lit(0)) for k in h) / F.lit(float(width))
    g = g.select("pattern", "n_parts", "low", "high", share(lambda k: F.col(f"top.{k}") == F.col(f"u{k}")).alias("sim"), share(lambda k: F.col(f"i{k}") == F.col(f"u{k}")).alias("gamma"))
    union = F.col("high") / F.when(F.col("sim") == 0, F.lit(coverage)).otherwise(F.col("sim"))
    weak = (union / F.greatest("low", F.lit(1.0)) > width) | (F.col("gamma") == 0)
    gamma = F.when(weak, F.least(F.try_divide("low", "high"), F.lit(1.0 / width))).otherwise(F.col("gamma"))
    g = g.select("pattern", "n_parts", F.when(F.col("low") == 0, 0.0).otherwise(F.least(union * gamma, F.col("low"))).alias("est"))
    return patterns.select("pattern").distinct().join(g, "pattern", "left").select("pattern", F.coalesce("n_parts", F.lit(0)).cast("long").alias("n_parts"), F.coalesce("est", F.when(F.col("pattern") == "", 0.0).otherwise(float(total))).alias("est"))


def coverage(patterns: DataFrame, cards: DataFrame, table: DataFrame, n: int, width: int) -> float:
    """Mean over patterns with matches of their largest part's count by their own (1 if there are none)."""
    x = part_signatures(parts(patterns), table, n, width).groupBy("pattern").agg(F.max("card").alias("high"))
    r = x.join(cards.where("card > 0"), "pattern").where("high > 0").agg(F.avg(F.col("high") / F.col("card"))).first()[0]
    return 1.0 if r is None else float(r)
