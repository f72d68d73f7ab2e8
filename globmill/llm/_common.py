"""What the operators of this folder share: tables, Arrow batch bounds, lineage cuts and connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python. Texts may reach megabytes, so a batch stays small.
BATCH_ROWS = 256

#: White space of the contracts: blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the path may be of any file system)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that a Python worker's memory doesn't follow the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """After training in the driver: hand freed memory back to the system, where the C library can do so (glibc)."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without (tests): it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors and driver need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="globmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it again: lineage is cut there and survives lost executors.

    What is stored goes when the session ends (or with forget()); until then results may be read from it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/globmill/{what}-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _PATHS.append(path)
    return out


#: Paths of what this process stored and didn't delete yet.
_PATHS: list[str] = []


def delete_at_end(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.deleteOnExit(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)
    if path in _PATHS:
        _PATHS.remove(path)


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these frames: nothing may be read from them any more."""
    for df in frames:
        delete(df.sparkSession, df._stored_at)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end: its results have to be written by then."""
    before = set(_PATHS)
    yield
    for path in [p for p in _PATHS if p not in before]:
        delete(spark, path)


def sampled(df: DataFrame, by: list[str], bound: int, group: str | None = None) -> DataFrame:
    """At most `bound` rows (of each group) with different values of `by`: those with the least 64-bit hashes of them.

    The number of different hashes is estimated first, and only rows below about 1.5 * bound + 30 of them go on, so a task
    gets few rows whatever the table's size, and copies of a row, however many, are one row of the sample. Groups are few
    (labels, languages); a group of null isn't sampled.
    """
    name = group or "_all"
    x = df.withColumn("_all", F.lit(0)).withColumn("_hash", F.xxhash64(*by)).where(F.col(name).isNotNull())
    told = x.groupBy(name).agg(F.approx_count_distinct("_hash").alias("n")).collect()  # a row for each group
    if not told:
        return df.limit(0)
    below = F.lit(None).cast("long")
    for r in told:
        share = (1.5 * bound + 30) / max(1, r["n"])
        below = F.when(F.col(name) == F.lit(r[name]), F.lit(2**63 - 1 if share >= 0.9 else -(2**63) + int(share * 2**64))).otherwise(below)
    one = x.where(F.col("_hash") <= below).dropDuplicates([name, "_hash"])
    nth = F.row_number().over(W.partitionBy(name).orderBy("_hash"))
    return one.withColumn("_nth", nth).where(F.col("_nth") <= bound).select(*df.columns)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's text modulo n: the folds that the contracts fix."""
    return F.crc32(key.cast("string").cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    edges: columns u, v (long); loops and repeats do no harm. Returns node, component (smallest node reachable) for
    every node that has an edge to another one. A large-star links each neighbour above a node to the least node of
    its neighbourhood, a small-star those below it; the pair is repeated until the edges stay as they are, when they
    are stars around the components' least nodes. Only counts and sums reach the driver. A hub's neighbourhood is
    never collected: its minimum is an aggregate with a map-side part, and the join with the minima can be split.
    """
    e = stored(
        edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v").distinct(),
        "edges",
    )
    sign, kept = _signature(e), e
    for _ in range(rounds):
        # large-star: both directions, so that each node sees all its neighbours
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: each node's smaller neighbours and itself go to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(least, "u")
        e = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        before, e = kept, stored(e, "edges")
        kept = e
        forget(before)
        now = _signature(e)
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components: the edges still change after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _signature(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.col("u") - F.col("v")).cast("decimal(38,0)"))).first()
    return tuple(row)
