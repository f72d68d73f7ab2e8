"""Estimates from n-gram tables beside exact counts, and what reports and training sets are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import statistics as S


def table_key(q: Column) -> Column:
    """A pattern with one part as a key of the n-gram table; null if it has more parts or none."""
    flipped = P.canonical(q, True)
    left, right = F.when(flipped.startswith("%"), "").otherwise(S.START), F.when(flipped.endswith("%"), "").otherwise(S.END)
    core = F.regexp_replace(flipped, "^%+|%+$", "")
    return F.when((core != "") & ~F.contains(core, F.lit("%")), F.concat(left, F.replace(core, F.lit("_"), F.lit(S.ANY)), right))


def exact_hits(table: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """pattern, cnt: patterns of one part and at most n characters, with their exact count where the table holds it (else null)."""
    keyed = patterns.select("pattern").distinct().withColumn("gram", table_key(F.col("pattern")))
    keyed = keyed.withColumn("gram", F.when(S.gram_length(F.col("gram")) <= n, F.col("gram")))
    return keyed.join(table.select("gram", "cnt"), "gram", "left").select("pattern", "cnt")


def bound_report(bounds: DataFrame, cards: DataFrame) -> DataFrame:
    """avg, std (of all), max of bound / card over patterns with matches, and whether every bound holds. bounds: pattern, bound; cards: pattern, card."""
    x = bounds.join(cards, "pattern")
    ratio = F.when(F.col("card") > 0, F.col("bound") / F.nullif("card", F.lit(0)))
    return x.agg(F.avg(ratio).alias("avg_ratio"), F.stddev_pop(ratio).alias("std_ratio"), F.max(ratio).alias("max_ratio"), (F.count_if(F.col("bound") < F.col("card")) == 0).alias("holds"))


def negated(x: DataFrame, total: Column, nulls: Column) -> DataFrame:
    """x: pattern, est. Adds est_not_like (rows neither null nor matching) and est_not_equal (rows without the match)."""
    return x.withColumn("est_not_like", F.greatest(F.lit(0.0), total - nulls - F.col("est"))).withColumn("est_not_equal", F.greatest(F.lit(0.0), total - F.col("est")))


def padded(codes: Column, width: Column, filler: int = 0) -> Column:
    """An array with the filler at its end, as long as width."""
    return F.concat(codes, F.array_repeat(F.lit(filler), F.greatest(F.lit(0), width - F.size(codes)).cast("int")))


def encoded(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """pattern, canonical, len, ids: character codes, padded with 0 to the longest pattern. vocabulary: ch, idx (from 0); code idx + 1, of unknown characters one above all.

    Characters are exploded and joined, so the vocabulary is broadcast only where Spark knows that it is small; the
    longest pattern and the largest code are aggregates of one row.
    """
    p = patterns.select("pattern").distinct().withColumn("canonical", P.canonical(F.col("pattern")))
    most = p.agg(F.max(F.length("canonical")).alias("width")).crossJoin(vocabulary.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 2).alias("unknown")))
    ch = p.select("pattern", F.posexplode(F.filter(F.split("canonical", ""), lambda x: x != "")).alias("at", "ch")).join(vocabulary.select("ch", (F.col("idx") + 1).alias("id")), "ch", "left")
    ids = ch.crossJoin(F.broadcast(most)).groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", "unknown").alias("id"))))["id"].alias("ids"))
    out = p.join(ids, "pattern", "left").crossJoin(F.broadcast(most))
    return out.select("pattern", "canonical", F.length("canonical").alias("len"), padded(F.coalesce("ids", F.array().cast("array<int>")), F.col("width")).alias("ids"))


def prefix_labels(patterns: DataFrame, labels: DataFrame) -> DataFrame:
    """pattern, i, prefix, card, mask: every prefix of a canonical pattern with its label; mask is 0 where there is none. labels: pattern, card."""
    p = patterns.select(P.canonical(F.col("pattern")).alias("pattern")).distinct()
    x = p.select("pattern", F.posexplode(P.prefixes(F.col("pattern"))).alias("i", "prefix"))
    known = labels.select(F.col("pattern").alias("prefix"), "card").dropDuplicates(["prefix"])
    return x.join(known, "prefix", "left").select("pattern", (F.col("i") + 1).alias("i"), "prefix", F.coalesce("card", F.lit(0)).cast("long").alias("card"), F.col("card").isNotNull().cast("int").alias("mask"))


def all_tokens_occur(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, n: weight of the strings that hold all of a pattern's tokens, in any order; of all strings for patterns without tokens."""
    from .counting import holders

    p = patterns.select("pattern").distinct().withColumn("t", P.tokens(F.col("pattern")))
    whole = strings.agg(F.sum("w").alias("w"))
    # one expression without lambda functions, which a join's condition can hold: a look ahead for each token
    quoted = F.transform("t", lambda t: F.concat(F.lit(r"(?=.*\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")))
    look = p.where(F.size("t") > 0).select("pattern", F.size("t").alias("m"), F.concat(F.lit("(?s)^"), F.array_join(quoted, "")).alias("look"))
    hits = holders(strings, look, edges=False).where((F.col("m") <= 2) | F.rlike("s", F.col("look"))).select("pattern", "w")
    hits = hits.unionAll(p.where(F.size("t") == 0).crossJoin(F.broadcast(whole)).select("pattern", "w"))
    hits = hits.groupBy("pattern").agg(F.sum("w").alias("n"))
    return p.select("pattern").join(hits, "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def neighbour_lcp(patterns: DataFrame, width: int = 4) -> DataFrame:
    """pattern, lcp: longest common prefix with the pattern before it in code point order, without one task for all.

    Patterns are grouped by their first characters; only a group's first pattern needs the last one of another group,
    and those are one row a group.
    """
    x = patterns.select("pattern").distinct().withColumn("_head", F.substring("pattern", 1, width))
    heads = x.groupBy("_head").agg(F.max("pattern").alias("_last"))
    heads = heads.select("_head", F.lag("_last", 1, "").over(W.orderBy("_head")).alias("_other"))
    x = x.withColumn("_before", F.lag("pattern").over(W.partitionBy("_head").orderBy("pattern"))).join(heads, "_head")
    return x.select("pattern", F.size(F.filter(P.prefixes(F.col("pattern")), lambda p: F.startswith(F.coalesce("_before", "_other"), p))).alias("lcp"))


def shared_starts(patterns: DataFrame, width: int = 4) -> DataFrame:
    """pattern, nth (from 0), shares: patterns in wildcard-aware order (see patterns.sort_key), and whether the next one goes on from this one with a wildcard, so that what is found for its last token is of use again.

    In that order all continuations of a pattern follow it, those by a wildcard first: so a pattern shares just if another
    one starts with it and goes on with a wildcard, which an equality join on prefixes tells. Ranks are made inside groups
    of the first `width` signs, whose sizes alone are summed in one task.
    """
    p = patterns.select(P.canonical(F.col("pattern")).alias("pattern")).distinct()
    cut = F.filter(F.transform(P.prefixes(F.col("pattern")), lambda x: F.when(F.substr("pattern", F.length(x) + 1, F.lit(1)).isin("%", "_") & ~x.rlike("[%_]$"), x)), lambda x: x.isNotNull())
    heads = p.select(F.explode(cut).alias("pattern")).distinct().withColumn("_on", F.lit(True))
    x = p.withColumn("_key", P.sort_key(F.col("pattern"))).withColumn("_head", F.slice("_key", 1, width))
    sizes = x.groupBy("_head").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_head", F.coalesce(F.sum("_n").over(W.orderBy("_head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    x = x.withColumn("_own", F.row_number().over(W.partitionBy("_head").orderBy("_key")) - 1).join(sizes, "_head")
    return x.join(heads, "pattern", "left").select("pattern", (F.col("_ahead") + F.col("_own")).cast("long").alias("nth"), F.coalesce("_on", F.lit(False)).alias("shares"))


def hash_ranks(records: DataFrame, a: int, b: int, prime: int = 2**31 - 1) -> DataFrame:
    """rid, rank: the place of (rid * a + b) mod prime among all records, from 0, without one task for all. records: rid (different ones)."""
    x = records.select("rid", F.pmod(F.col("rid") * a + b, F.lit(prime)).alias("_h")).withColumn("_b", F.floor(F.col("_h") / (prime / 4096)))
    sizes = x.groupBy("_b").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return x.join(F.broadcast(sizes), "_b").select("rid", (F.col("_ahead") + F.row_number().over(W.partitionBy("_b").orderBy("_h", "rid")) - 1).cast("long").alias("rank"))


def chain_products(chain: DataFrame, total: int) -> DataFrame:
    """pattern, est: the product of a pattern's conditional ratios times all records; 0 once a ratio is 0. chain: pattern, ratio."""
    p = F.when(F.min("ratio") <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.greatest("ratio", F.lit(1e-300))))))
    return chain.groupBy("pattern").agg((p * F.lit(float(total))).alias("est"))


def packed_loss(x: DataFrame) -> DataFrame:
    """n, loss: mean squared log error over the prefixes that count: within the pattern and not answered by the table. x: prefix_len, len, in_table, true, est."""
    soft = lambda v: F.log1p(F.greatest(v.cast("double"), F.lit(1e-7)))
    on = x.where((F.col("prefix_len") <= F.col("len")) & ~F.col("in_table"))
    return on.agg(F.count("*").alias("n"), F.avg(F.pow(soft(F.col("est")) - soft(F.col("true")), 2)).alias("loss"))


def chain_loss(x: DataFrame) -> DataFrame:
    """n, loss: mean binary cross-entropy of conditional probabilities where the mask is 1. x: p, target, mask."""
    on = x.where("mask = 1")
    return on.agg(F.count("*").alias("n"), F.avg(S.cross_entropy(F.col("p"), F.col("target"))).alias("loss"))


def typed_parts(patterns: DataFrame) -> DataFrame:
    """pattern, i, part, kind: the parts between `%` with the kind of embedding that reads them: the first one of a prefix pattern, the last one of a suffix pattern, all others substrings (those of exact patterns too)."""
    q = P.canonical(F.col("pattern"), True)
    left, right = q.startswith("%"), q.endswith("%")
    x = patterns.select("pattern").distinct().select("pattern", left.alias("l"), right.alias("r"), F.filter(F.split(q, "%+"), lambda t: t != "").alias("ps"))
    x = x.select("pattern", "l", "r", F.size("ps").alias("k"), F.posexplode("ps").alias("i", "part"))
    kind = F.when(~F.col("l") & F.col("r") & (F.col("i") == 0), "prefix").when(F.col("l") & ~F.col("r") & (F.col("i") == F.col("k") - 1), "suffix").otherwise("substring")
    return x.select("pattern", "i", "part", kind.alias("kind"))


def readable_only(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Patterns whose characters are all in the vocabulary (ch); wildcards always are."""
    ch = patterns.select("pattern").distinct().select("pattern", F.explode(F.array_distinct(F.filter(F.split("pattern", ""), lambda x: ~x.isin("", "%", "_")))).alias("ch"))
    odd = ch.join(vocabulary.select("ch"), "ch", "left_anti").select("pattern").distinct()
    return patterns.join(odd, "pattern", "left_anti")


def vocabulary(strings: DataFrame, most: int = 200) -> DataFrame:
    """ch, idx: the `most` most frequent characters (ties by code point); the cap is the feature, all others are one unknown sign."""
    return S.char_stats(strings).where(F.col("idx") < most).select("ch", "idx")


def log_scaled(x: DataFrame, column: str) -> DataFrame:
    """Adds `scaled`: the logarithm of a count (at least 1), 0 at the least and 1 at the greatest; 0 if all are alike."""
    v = F.ln(F.greatest(F.col(column).cast("double"), F.lit(1.0)))
    ends = x.agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    y = x.crossJoin(F.broadcast(ends))
    scaled = F.coalesce(F.try_divide(v - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return y.withColumn("scaled", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))).drop("_low", "_high")


def unscaled(scaled: Column, low: float, high: float) -> Column:
    """The count that a scaled logarithm stands for; low and high are the logarithms of the least and the greatest count."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))
    return F.exp(s * (high - low) + low)
