"""Learned estimates: exact counts where the n-gram table has them, else the bound scaled by a model; token vectors.

Models are fitted with Spark ML on all rows of the workload given; vectors of words are averaged over a pattern's parts.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import reports as R
from . import statistics as S

FEATURES = ("log_bound", "n_signs", "n_tokens", "n_under", "longest", "left", "right")


def features(bounds: DataFrame) -> DataFrame:
    """bounds: pattern, bound. Adds what the model reads of a pattern."""
    q, t = F.col("pattern"), P.tokens(F.col("pattern"))
    d = lambda c: c.cast("double")
    return bounds.select(
        "*", F.ln(F.greatest(d(F.col("bound")), F.lit(1.0))).alias("log_bound"), d(F.length(q)).alias("n_signs"), d(F.size(t)).alias("n_tokens"),
        d(F.length(F.regexp_replace(q, "[^_]", ""))).alias("n_under"), d(F.coalesce(F.array_max(F.transform(t, F.length)), F.lit(0))).alias("longest"),
        d(q.startswith("%")).alias("left"), d(q.endswith("%")).alias("right"),
    )


def fit(bounds: DataFrame, cards: DataFrame, rounds: int = 20, depth: int = 4):
    """A boosted model of ln(bound / card), both at least 1. cards: pattern, card (all labelled patterns)."""
    one = F.lit(1.0)
    x = features(bounds.join(cards, "pattern")).withColumn("label", F.col("log_bound") - F.ln(F.greatest(F.col("card").cast("double"), one)))
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(x)
    return GBTRegressor(maxIter=rounds, maxDepth=depth, seed=0).fit(x)


def estimate(model, bounds: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """pattern, bound, exact, est: exact counts of the table first; else bound / e^model, at most the bound."""
    x = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(bounds)))
    x = x.select("pattern", "bound", F.least(F.col("bound").cast("double"), F.col("bound") * F.exp(-F.greatest(F.lit(0.0), F.col("prediction")))).alias("_est"))
    hits = R.exact_hits(table, bounds, n)
    return x.join(hits, "pattern", "left").select("pattern", "bound", F.col("cnt").alias("exact"), F.coalesce(F.col("cnt").cast("double"), "_est").alias("est"))


def q_errors_by(x: DataFrame, *keys: Column) -> DataFrame:
    """x: pattern, true, est. Rows and mean and greatest Q-error by length, number of wildcards, or other keys."""
    return x.withColumn("q", S.q_error(F.col("true"), F.col("est"))).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("q").alias("avg_q"), F.max("q").alias("max_q"))


def ratio_for_size(table: DataFrame, most: int, steps: int = 12) -> tuple[float, int]:
    """The greatest ratio (to 2^-steps) whose pruned table has at most `most` keys, and its number of keys, by bisection.

    The table's counts by length and count alone are kept (bounded by the lengths times the distinct counts), so a step
    reads that histogram, not the table.
    """
    hist = table.withColumn("glen", S.gram_length(F.col("gram"))).groupBy("glen", "cnt").agg(F.count("*").alias("keys"))
    w = W.partitionBy("glen").orderBy(F.desc("cnt"))
    hist = hist.withColumn("upto", F.sum("keys").over(w)).cache()
    base = hist.where("glen = 2").agg(F.sum("keys")).first()[0] or hist.where("glen = 1").agg(F.sum("keys")).first()[0] or 0

    def size(ratio: float) -> int:
        limit = int(ratio * base)
        # a count stays if all keys down to it are at most the limit; the tie at the limit drops out
        return hist.where(F.col("upto") <= limit).agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]

    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if size(mid) <= most else (low, mid)
    found = size(low)
    hist.unpersist()
    return low, found


def token_vectors(sentences: DataFrame, width: int = 16, window: int = 5, least: int = 1) -> DataFrame:
    """token, vec: skip-gram vectors of a dictionary's sentences. sentences: sentence (tokens between spaces)."""
    x = sentences.select(F.filter(F.split("sentence", " "), lambda t: t != "").alias("tokens"))
    m = Word2Vec(vectorSize=width, windowSize=window, minCount=least, maxIter=1, seed=0, inputCol="tokens", outputCol="v").fit(x)
    return m.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vec"))


def pattern_vectors(patterns: DataFrame, vectors: DataFrame, prefix: str) -> DataFrame:
    """pattern, n_known, vec: the mean over a pattern's parts of the vector of the longest known substring that starts or ends the part (null: none known).

    Candidates are joined by equality; only the longest hit of each part is kept. vectors: token (with the column's prefix), vec.
    """
    part = F.split(F.col("pattern"), "[%_]+")
    x = patterns.select("pattern").distinct().select("pattern", F.posexplode(F.filter(part, lambda t: t != "")).alias("i", "part"))
    cut = F.array_distinct(F.concat(P.prefixes(F.col("part")), P.suffixes(F.col("part"))))
    x = x.select("pattern", "i", F.explode(cut).alias("cut")).withColumn("token", F.concat(F.lit(prefix), F.col("cut")))
    hit = x.join(vectors, "token").groupBy("pattern", "i").agg(F.max_by("vec", F.struct(F.length("cut"), "cut")).alias("vec"))
    flat = hit.select("pattern", "i", F.posexplode("vec").alias("k", "v")).groupBy("pattern", "k").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    mean = flat.groupBy("pattern").agg(F.max("n").alias("n_known"), F.array_sort(F.collect_list(F.struct("k", "v")))["v"].alias("vec"))
    return patterns.select("pattern").distinct().join(mean, "pattern", "left").select("pattern", F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"), "vec")
