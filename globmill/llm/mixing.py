"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule over training time (0 to 1), given by its values at knots with straight lines
between. Its integral, scaled so that all of it is the source's target, is the source's cumulative token demand; the sum
of all sources' demands is the token clock, which says how many words are trained on by a time. A source's documents
stand in the order of a hash and are run through epoch by epoch. A document copy lies at a stretch of its source's
stream; it is taken if the demand ever reaches its middle, and its training position is the token clock at the time at
which the demand reaches its first word. Sorting by ranges of the position gives the training order.

All of it is DataFrame code. Sums along a source's stream are made in two steps (sums of hash buckets, then inside a
bucket), so no source, however large, meets in one task, and nothing but the table of sources is held in whole: that
has a row for each source, and is broadcast only if Spark sees that it is small.

Defined results: a null text has size 0, a null source is a source of its own, last in order; documents of size 0 are
taken 0 times (their position is null); repeated rows are documents of their own with the same order key and count
each. An empty table gives an empty result. Extra columns aren't used; curriculum() gives them back, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often than this.
MOST = 3
#: Schedule values at times 0, 1/2 and 1, repeating like the weights: heavy sources fade, light ones grow.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Hash buckets of a source's stream. A bucket of the largest source is what one task sums.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but white space 9-13 and 32); 0 for null."""
    squeezed = F.regexp_replace(text, c.SPACE, " ")
    trimmed = F.trim(squeezed)
    return F.coalesce(F.when(F.length(trimmed) > 0, F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).otherwise(0), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes: source, source_size. Adds nth (order by code point, null last), weight, target.

    The whole size is shared by weight; a target stops at most x its source's size and what is above it is shared
    again by weight. The end of this is one level: the target is the lesser of the cap and level x weight. In the
    order of cap / weight, the level is that of the first source whose cap it doesn't pass, those before being at theirs.
    """
    nth = sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    x = nth.withColumn("weight", pick).withColumn("_cap", F.col("source_size").cast("double") * most).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    before = W.orderBy("_ratio", "nth").rowsBetween(W.unboundedPreceding, -1)
    from_here = W.orderBy("_ratio", "nth").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    x = x.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    x = x.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "nth", "_level"))).over(everything)["_level"])
    return x.withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("weight")), F.col("_cap"))).drop("_cap", "_ratio", "_level")


def _areas(values: Sequence[float]) -> list[float]:
    return [(a + b) / 2 / (len(values) - 1) for a, b in zip(values, values[1:], strict=False)]


def invert(share: Column, values: Sequence[float]) -> Column:
    """Time at which the integral of a piecewise linear schedule (knots evenly over 0..1) reaches a share of its whole."""
    n, areas = len(values) - 1, _areas(values)
    whole, before, out = sum(areas), 0.0, None
    for k, area in enumerate(areas):
        a, slope = float(values[k]), (values[k + 1] - values[k]) * n
        need = share * F.lit(whole) - F.lit(before)
        t = (F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + need * (2 * slope))) - a) / slope if slope else need / a
        piece = F.least(F.lit((k + 1) / n), F.lit(k / n) + F.greatest(F.lit(0.0), t))
        before += area
        out = piece if out is None else F.when(share * F.lit(whole) <= F.lit(before - area), out).otherwise(piece)
    return out


def integral(time: Column, values: Sequence[float]) -> Column:
    """Share of a schedule's whole that is reached at a time: the inverse of invert()."""
    n, areas = len(values) - 1, _areas(values)
    whole, before, out = sum(areas), 0.0, None
    for k, area in enumerate(areas):
        u = time - F.lit(k / n)
        piece = (F.lit(before) + u * float(values[k]) + u * u * ((values[k + 1] - values[k]) * n / 2)) / F.lit(whole)
        before += area
        out = piece if out is None else F.when(time <= F.lit(k / n), out).otherwise(piece)
    return out


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST, buckets: int = BUCKETS, order: str | None = None, schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """Per document: key, source, size, source_size, nth, target, start (words before it in its source's stream), times, taken, demands.

    A source's stream is in the order of the md5 of `order` (the key, unless given). Copy e of a document begins at word
    e * source_size + start of it and is taken if the demand, whose end is the target, reaches its middle: so the words
    taken differ from the target by half a document at most, and nothing is taken more than `most` times. demands: for
    each schedule the targets of all its sources, which the token clock needs.
    """
    hashed = F.md5(F.coalesce(F.col(order or key).cast("string"), F.lit("")).cast("binary"))
    base = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), hashed.alias("_order"))
    base = c.stored(base.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 6), 16, 10).cast("double") * (buckets / (1 << 24))).cast("int")), "mixing")
    sums = base.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sources = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, most)
    ahead = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    demands = F.array(*[F.coalesce(F.sum(F.when(F.col("nth") % len(schedules) == k, F.col("target"))).over(W.partitionBy()), F.lit(0.0)) for k in range(len(schedules))])
    sources = sources.withColumn("demands", demands)
    # one table of sources and buckets, so that documents are joined once
    sums = sums.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(F.col("b.source").alias("_source"), F.col("_bucket").alias("_b"), "_ahead", "source_size", "nth", "target", "demands")
    joined = base.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    inside = W.partitionBy("source", "_bucket").orderBy("_order", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    x = joined.withColumn("start", F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    reached = [(F.col("start") + F.col("size") / 2 + e * F.col("source_size") < F.col("target")).cast("int") for e in range(most)]
    x = x.withColumn("times", F.when(F.col("size") == 0, 0).otherwise(sum(reached[1:], reached[0])))
    return x.withColumn("taken", (F.col("times") * F.col("size")).cast("long")).select("key", "source", "size", "source_size", "nth", "target", "start", "times", "taken", "demands")


def clocked(planned: DataFrame, epochs: dict[str, Column], schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """Adds columns with the training positions of copies (name -> epoch): the words that all sources together are trained on before the demand of a document's source reaches the copy."""
    names = planned.columns
    x = planned.select("*", *[F.least(F.lit(1.0), F.try_divide(e * F.col("source_size") + F.col("start"), F.col("target"))).alias(f"_share_{k}") for k, e in epochs.items()])

    def of(share: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, values in enumerate(schedules):
            out = F.when(F.col("nth") % len(schedules) == k, invert(share, values)).otherwise(out)
        return out

    # a step each, so that an expression isn't copied into those that use it several times
    x = x.select("*", *[of(F.col(f"_share_{k}")).alias(f"_time_{k}") for k in epochs])
    words = lambda k: sum(F.get("demands", F.lit(j)) * integral(F.col(f"_time_{k}"), v) for j, v in enumerate(schedules))
    return x.select(*names, *[words(k).alias(k) for k in epochs])


def positions(planned: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """One row per document copy with its epoch (from 0) and its position on the token clock."""
    x = planned.where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return clocked(x, {"position": F.col("epoch")}, schedules)


def curriculum(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs repeated as the mix takes them, sorted by ranges of their position; the columns stay as they are.

    Rows that are alike in all columns are one document of as many times its size: they get the copies of all of them.
    """
    names = docs.columns
    keyed = docs.withColumn("_mix_key", F.concat_ws("/", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.xxhash64(*names, *[F.col(k).isNull() for k in names]).cast("string")))
    planned = plan(keyed.select("_mix_key", F.col(key).alias("_mix_order"), F.col(options.pop("text", "text")).alias("text"), F.col(options.pop("source", "source")).alias("source")), key="_mix_key", order="_mix_order", **options)
    placed = positions(planned).select(F.col("key").alias("_mix_key"), F.col("position").alias("_mix_position"), F.col("epoch").alias("_mix_epoch"))
    # the text goes through one shuffle by the key, for the removal of repeats and the join, and one by position
    out = keyed.dropDuplicates(["_mix_key"]).join(placed, "_mix_key")
    return out.repartitionByRange(F.col("_mix_position"), F.col("_mix_key")).sortWithinPartitions("_mix_position", "_mix_key", "_mix_epoch").select(*names)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, sorted by ranges of the first copy's position: what it takes of each, and where the first and the last copy stand."""
    planned = plan(c.table(spark, sf_dir, "documents"))
    x = clocked(planned, {"position": F.lit(0), "last_position": F.greatest(F.lit(0), F.col("times") - 1)})
    place = lambda k: F.round(F.when(F.col("times") > 0, F.col(k)), 3).alias(k)
    out = x.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", place("position"), place("last_position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS nth FROM s),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 3.0::DOUBLE * source_size AS cap FROM n),
l AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT *, coalesce(least(cap, weight * (min(CASE WHEN level <= ratio THEN {'r': ratio, 'n': nth, 'l': level} END) OVER ()).l), cap) AS target FROM l),
m AS (SELECT *, coalesce(sum(target) FILTER (nth % 3 = 0) OVER (), 0) AS d0, coalesce(sum(target) FILTER (nth % 3 = 1) OVER (), 0) AS d1, coalesce(sum(target) FILTER (nth % 3 = 2) OVER (), 0) AS d2 FROM t),
x AS (
  SELECT d.rid, d.doc_id, d.size, m.source_size, m.target, m.nth, d0, d1, d2,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
y AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (start + size / 2 < target)::INT + (start + size / 2 + source_size < target)::INT + (start + size / 2 + 2 * source_size < target)::INT END AS times
  FROM x),
e AS (SELECT *, unnest([0, times - 1]) AS epoch, unnest([1, 2]) AS which FROM y),
h AS (SELECT *, least(1.0, (epoch * source_size + start) / nullif(target, 0)) AS share FROM e),
i AS (
  SELECT *, CASE nth % 3
    WHEN 1 THEN CASE WHEN share <= 0.5 THEN least(0.5, share) ELSE least(1.0, 0.5 + greatest(0, share - 0.5)) END
    WHEN 0 THEN CASE WHEN share <= 0.625 THEN least(0.5, greatest(0, (sqrt(greatest(0, 2.25 - 2 * share)) - 1.5) / -1))
                     ELSE least(1.0, 0.5 + greatest(0, (sqrt(greatest(0, 1 - 2 * (share - 0.625))) - 1) / -1)) END
    ELSE CASE WHEN share <= 0.375 THEN least(0.5, greatest(0, sqrt(greatest(0, 0.25 + 2 * share)) - 0.5))
              ELSE least(1.0, 0.5 + greatest(0, sqrt(greatest(0, 1 + 2 * (share - 0.375))) - 1)) END
  END AS t FROM h),
p AS (
  SELECT *, CASE WHEN times > 0 THEN round(
    d0 * CASE WHEN t <= 0.5 THEN t * 1.5 - t * t * 0.5 ELSE 0.625 + (t - 0.5) - (t - 0.5) * (t - 0.5) * 0.5 END + d1 * t
    + d2 * CASE WHEN t <= 0.5 THEN t * 0.5 + t * t * 0.5 ELSE 0.375 + (t - 0.5) + (t - 0.5) * (t - 0.5) * 0.5 END, 3) END AS place
  FROM i)
SELECT a.doc_id, a.size, a.source_size, a.target, (a.times * a.size)::BIGINT AS taken, a.place AS position, b.place AS last_position
FROM p a JOIN p b ON a.rid = b.rid AND a.which = 1 AND b.which = 2
"""
