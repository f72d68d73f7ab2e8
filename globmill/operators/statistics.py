"""Statistics of string tables: n-gram tables, bounds, summaries, min-hash signatures, samples, and error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P

# Marks of a string's start and end and of any character in the keys of n-gram tables.
START, END, ANY = "˂", "˃", "‼"


def _masks(g: Column) -> Column:
    """All 2^length variants of a gram with characters replaced by ANY."""
    n = F.length(g)
    masked = lambda m: F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.floor(m / F.pow(F.lit(2), i - 1)) % 2 == 1, F.lit(ANY)).otherwise(F.substr(g, i, F.lit(1))))
    return F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), n).cast("int") - 1), lambda m: F.array_join(masked(m), ""))


def ngram_table(strings: DataFrame, n: int) -> DataFrame:
    """gram, cnt: records that hold each masked gram of up to n characters, anywhere or (marked) at the start, the end, or as the whole; the empty gram counts all."""
    s = F.col("s")
    sizes = F.sequence(F.lit(1), F.least(F.lit(n), F.length(s)))
    subs = F.when(F.length(s) > 0, F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substr(s, i, k))))).otherwise(F.array().cast("array<string>"))
    marked = lambda a, b: lambda g: F.transform(_masks(g), lambda x: F.concat(F.lit(a), x, F.lit(b)))
    pre = F.when(F.length(s) > 0, F.transform(sizes, lambda k: F.substr(s, F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    suf = F.when(F.length(s) > 0, F.transform(sizes, lambda k: F.substr(s, F.length(s) - k + 1, k))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.length(s) == 0, F.array(F.lit(START + END))).when(F.length(s) <= n, marked(START, END)(s)).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(F.array_distinct(subs), lambda g: _masks(g))), F.flatten(F.transform(pre, marked(START, ""))), F.flatten(F.transform(suf, marked("", END))), whole))
    return strings.select("w", F.explode(keys).alias("gram")).groupBy("gram").agg(F.sum("w").alias("cnt"))


def gram_length(g: Column) -> Column:
    return F.length(F.translate(g, START + END, ""))


def prune_top(table: DataFrame, ratio: float) -> DataFrame:
    """gram, cnt, pt: for each length, counts above the one at rank int(ratio * keys of length 2); ties there drop out."""
    x = table.withColumn("glen", gram_length(F.col("gram")))
    most = x.agg(F.floor(F.lit(ratio) * F.greatest(F.count_if(F.col("glen") == 2), F.when(F.count_if(F.col("glen") == 2) == 0, F.count_if(F.col("glen") == 1)).otherwise(0))).alias("most"))
    # the count at a rank follows from how many keys have each count, which are few rows
    hist = x.groupBy("glen", "cnt").agg(F.count("*").alias("keys"))
    hist = hist.withColumn("upto", F.sum("keys").over(W.partitionBy("glen").orderBy(F.desc("cnt"))))
    hit = (F.col("upto") > F.col("most")) & (F.col("upto") - F.col("keys") <= F.col("most"))
    at = hist.crossJoin(F.broadcast(most)).groupBy("glen").agg(F.coalesce(F.max(F.when(hit, F.col("cnt"))) + 1, F.lit(1)).alias("pt"))
    return x.join(F.broadcast(at), "glen").where("cnt >= pt").select("gram", "glen", "cnt", "pt")


def upper_bound(table: DataFrame, patterns: DataFrame, n: int, pt: int | dict[int, int], shorter: bool = True) -> DataFrame:
    """pattern, bound: the least count over the sub-grams of a pattern's parts; an absent gram counts pt - 1 (pt: one for all, or by the gram's length). table: gram, cnt. shorter: false takes the longest sub-grams alone."""
    q = F.replace(P.canonical(F.col("pattern"), True), F.lit("_"), F.lit(ANY))
    left, right = ~q.startswith("%"), ~q.endswith("%")
    part = patterns.select("pattern").distinct().select("pattern", left.alias("l"), right.alias("r"), F.split(F.regexp_replace(q, "^%+|%+$", ""), "%+").alias("parts"))
    one = part.select("pattern", "l", "r", F.size("parts").alias("k"), F.posexplode("parts").alias("i", "b")).where("b <> ''")
    sub = one.withColumn("n", F.explode(F.sequence(F.lit(1) if shorter else F.least(F.lit(n), F.length("b")), F.least(F.lit(n), F.length("b"))))).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("b") - F.col("n") + 1)))
    key = F.concat(
        F.when(F.col("l") & (F.col("i") == 0) & (F.col("at") == 1), F.lit(START)).otherwise(""),
        F.substr("b", "at", "n"),
        F.when(F.col("r") & (F.col("i") == F.col("k") - 1) & (F.col("at") == F.length("b") - F.col("n") + 1), F.lit(END)).otherwise(""),
    )
    absent = F.lit(pt - 1) if isinstance(pt, int) else F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(pt.items()) for x in (k, v - 1)]), gram_length(F.col("gram")))
    got = sub.select("pattern", key.alias("gram")).distinct().join(table.select("gram", "cnt"), "gram", "left").groupBy("pattern").agg(F.min(F.coalesce("cnt", absent)).alias("least"))
    whole = table.where("gram = ''").agg(F.max("cnt").alias("n_all"))
    return patterns.select("pattern").distinct().join(got, "pattern", "left").crossJoin(F.broadcast(whole)).select("pattern", F.least(F.coalesce("least", "n_all"), "n_all").cast("long").alias("bound"))


def prefix_bounds(table: DataFrame, patterns: DataFrame, n: int, pt: int | dict[int, int]) -> DataFrame:
    """pattern, prefix_len, prefix, bound, in_table: the bound of every prefix of a flipped pattern, and whether the table itself answers it. Shared prefixes are bounded once."""
    from .reports import exact_hits

    x = patterns.select("pattern").distinct().select("pattern", F.posexplode(P.prefixes(P.canonical(F.col("pattern"), True))).alias("i", "prefix"))
    each = x.select(F.col("prefix").alias("pattern")).distinct()
    told = upper_bound(table, each, n, pt).join(exact_hits(table, each, n), "pattern").select(F.col("pattern").alias("prefix"), "bound", F.col("cnt").isNotNull().alias("in_table"))
    return x.join(told, "prefix").select("pattern", (F.col("i") + 1).alias("prefix_len"), "prefix", "bound", "in_table")


def summary(strings: DataFrame, way: str, most: int = 8) -> DataFrame:
    """part, card: records (without wildcards) that have each string of up to `most` characters as prefix, suffix or substring."""
    s = F.col("s")
    parts = {"prefix": P.prefixes_upto, "suffix": P.suffixes_upto, "substring": P.parts_upto}[way](s, most)
    return strings.where(~s.rlike("[%_]")).select("w", F.explode(parts).alias("part")).groupBy("part").agg(F.sum("w").alias("card"))


def transitions(strings: DataFrame, most: int = 8) -> DataFrame:
    """parent, child, p: to each child in the prefix tree by frequency (counts begin at 1), leaving a share for the way up."""
    node = summary(strings, "prefix", most).select(F.col("part").alias("child"), (F.col("card") + 1).alias("f")).withColumn("parent", F.expr("substring(child, 1, length(child) - 1)"))
    own = W.partitionBy("parent")
    k = F.count("*").over(own)
    return node.select("parent", "child", (F.col("f") / F.sum("f").over(own) * F.when(F.length("parent") <= 1, 1.0).otherwise(k / (k + 1))).alias("p"))


def char_stats(strings: DataFrame) -> DataFrame:
    """ch, idx (0 is the most frequent), n_occ, n_rec, n_pre, n_suf."""
    s = F.col("s")
    x = strings.where("s <> ''").select("s", "w", F.explode(F.split(s, "")).alias("ch")).where("ch <> ''").groupBy("s", "w", "ch").agg(F.count("*").alias("n"))
    got = x.groupBy("ch").agg(F.sum(F.col("n") * F.col("w")).alias("n_occ"), F.sum("w").alias("n_rec"), F.sum(F.when(s.startswith(F.col("ch")), F.col("w")).otherwise(0)).alias("n_pre"), F.sum(F.when(s.endswith(F.col("ch")), F.col("w")).otherwise(0)).alias("n_suf"))
    return got.withColumn("idx", F.row_number().over(W.orderBy(F.col("n_occ").desc(), "ch")) - 1)


def minhash_signatures(records: DataFrame, n: int, a: list[int], b: list[int], prime: int = 2**31 - 1) -> DataFrame:
    """gram, cnt, h1 .. hL: for each gram the least of (rid * A_i + B_i) mod prime over its records. records: rid, s."""
    s = F.col("s")
    x = records.select("rid", F.explode(P.parts_upto(s, n)).alias("gram"))
    return x.groupBy("gram").agg(F.count("*").alias("cnt"), *[F.min(F.pmod(F.col("rid") * p + q, F.lit(prime))).alias(f"h{i + 1}") for i, (p, q) in enumerate(zip(a, b, strict=True))])


def sample(records: DataFrame, key: str, m: int, seed: str = "0") -> DataFrame:
    """The m records first by md5 of seed and key: the same in every run and engine."""
    return records.orderBy(F.md5(F.concat(F.lit(seed + "-"), F.col(key).cast("string")).cast("binary")), key).limit(m)


def shuffled_rank(x: DataFrame, key: str, seed: str = "0", by: list[str] | None = None) -> DataFrame:
    """Adds rank (from 0, in the order of md5 of seed and key, then key; inside each group of the columns `by`) and total.

    Rows are ranked inside 4096 hash buckets, whose sizes alone are summed in one task (a group's).
    """
    by = by or []
    o = F.md5(F.concat(F.lit(seed + "-"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    y = x.withColumn("_o", o).withColumn("_b", F.substring("_o", 1, 3))
    sizes = y.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"), F.sum("_n").over(W.partitionBy(*by)).alias("total"))
    own = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_o", key)) - 1
    return y.join(sizes if by else F.broadcast(sizes), [*by, "_b"]).withColumn("rank", F.col("_ahead") + own).drop("_o", "_b", "_ahead")


def _matches(sampled: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, k: matches of each pattern in a sample (a bounded number of rows: it is broadcast)."""
    p = patterns.select("pattern").distinct()
    return p.join(F.broadcast(sampled.select("s")), P.like("s", "pattern"), "left").groupBy("pattern").agg(F.count("s").alias("k"))


def est_s(sampled: DataFrame, patterns: DataFrame, n: int, m: int) -> DataFrame:
    """pattern, k, est: matches in the sample scaled up; none counts as half a one."""
    return _matches(sampled, patterns).withColumn("est", F.when(F.col("k") == 0, 0.5).otherwise(F.col("k")) * n / m)


def est_plain(sampled: DataFrame, patterns: DataFrame, n: int, m: int) -> DataFrame:
    """pattern, k, est: matches in the sample scaled up, as they are."""
    return _matches(sampled, patterns).withColumn("est", F.col("k") * F.lit(n / m))


def q_error(true: Column, est: Column) -> Column:
    t, e = F.greatest(true.cast("double"), F.lit(1.0)), F.greatest(est.cast("double"), F.lit(1.0))
    return F.greatest(t / e, e / t)


def q_error_stats(x: DataFrame) -> DataFrame:
    """x: true, est. Mean, percentiles (linear between ranks), geometric mean and MSLE."""
    y = x.withColumn("q", q_error(F.col("true"), F.col("est")))
    soft = lambda v: F.log1p(F.greatest(v.cast("double"), F.lit(1e-7)))
    return y.agg(F.avg("q").alias("avg_q"), *[F.percentile("q", p / 100).alias(f"q{p:03d}") for p in (50, 90, 99, 100)], F.exp(F.avg(F.ln("q"))).alias("geo_q"), F.avg(F.pow(soft(F.col("est")) - soft(F.col("true")), 2)).alias("msle"))


def q_error_percentiles(x: DataFrame, steps: int = 100) -> DataFrame:
    """x: true, est. p (1 .. 100), q: the percentiles of the Q-error, linear between ranks."""
    q = x.select(q_error(F.col("true"), F.col("est")).alias("q")).agg(F.percentile("q", [(i + 1) / steps for i in range(steps)]).alias("qs"))
    return q.select(F.posexplode("qs").alias("i", "q")).select((F.col("i") + 1).alias("p"), "q")


def iqr_mean(x: DataFrame, column: str) -> DataFrame:
    """Mean of what lies within 1.5 quartile distances of the quartiles."""
    v = F.col(column).cast("double")
    q = x.agg(F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"))
    w = 1.5 * (F.col("q3") - F.col("q1"))
    return x.crossJoin(F.broadcast(q)).where((v >= F.col("q1") - w) & (v <= F.col("q3") + w)).agg(F.avg(v).alias("iqr_mean"), F.count("*").alias("n"))


def cross_entropy(p: Column, target: Column) -> Column:
    """Binary cross-entropy of a probability, kept off 0 and 1."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p.cast("double")))
    return -(target * F.ln(q) + (1 - target) * F.ln(1 - q))
