"""Text and CSV sources and sinks: string tables, query files, labelled workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One string a line, empty lines too."""
    return spark.read.text(path).select(F.col("value").alias("s"))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """pattern, card; quotes doubled, no header."""
    return spark.read.schema("pattern string, card long").csv(path, quote='"', escape='"')


def distances(spark: SparkSession, path: str, delta: int) -> DataFrame:
    """pattern, cards: the counts c0 .. c_delta of a file with a header."""
    schema = "pattern string, " + ", ".join(f"c{i} long" for i in range(delta + 1))
    x = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')
    return x.select("pattern", F.array(*[f"c{i}" for i in range(delta + 1)]).alias("cards"))


def workload(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Labelled files as one table with a column split."""
    out = None
    for name, path in paths.items():
        x = labelled(spark, path).withColumn("split", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


def write_labelled(df: DataFrame, path: str) -> None:
    df.select("pattern", "card").write.csv(path, quote='"', escape='"')


def write_estimates(df: DataFrame, path: str, seconds: float | None = None) -> None:
    """query, true, est, q-error (and est_time, the seconds for a pattern) with a header."""
    from ..operators.statistics import q_error

    more = [] if seconds is None else [F.lit(seconds).alias("est_time")]
    df.select("query", "true", "est", q_error(F.col("true"), F.col("est")).alias("q-error"), *more).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def escaped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows without a header whose quotes are escaped by a backslash; empty fields are null."""
    return spark.read.schema(schema).csv(path, quote='"', escape="\\", multiLine=True)


def delimited(spark: SparkSession, path: str, schema: str, sign: str = "|") -> DataFrame:
    """Rows whose fields a sign ends, such as a benchmark's `.tbl` files; the empty field after the last one isn't read."""
    return spark.read.schema(schema).csv(path, sep=sign, enforceSchema=True)


def xml_field(spark: SparkSession, path: str, tag: str, field: str) -> DataFrame:
    """One string for each element `tag`: the text of its child `field` (empty if there is none)."""
    return spark.read.schema(f"`{field}` string").option("rowTag", tag).format("xml").load(path).select(F.coalesce(F.col(field), F.lit("")).alias("s"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One column as text, one row a line; null as an empty line."""
    df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.text(path)


def catalog_columns(spark: SparkSession) -> DataFrame:
    """table, column, type of the session's tables and views."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def headed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows under a header, typed by the schema; empty fields are null."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', enforceSchema=True)


def typed_tables(spark: SparkSession, folder: str, schemas: dict[str, str], header: bool = False) -> dict[str, DataFrame]:
    """Tables of a folder of CSV files, `<folder>/<table>.csv`, each with its columns' types; quotes are escaped by a backslash unless there is a header."""
    read = headed_csv if header else escaped_csv
    return {t: read(spark, f"{folder}/{t}.csv", schema) for t, schema in schemas.items()}


def write_counts(df: DataFrame, path: str, augment: str = "base") -> None:
    """Counts: pattern, card; augmented by prefixes or suffixes, a pattern with the counts of all of them in order."""
    if augment in ("prefix", "suffix"):
        n = f"{augment}_len"
        df = df.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct(n, "card")))["card"].alias("cards"))
        df = df.select("pattern", F.array_join(F.transform("cards", lambda c: c.cast("string")), " ").alias("card"))
    df.select("pattern", "card").write.mode("overwrite").csv(path, quote='"', escape='"')


def write_times(spark: SparkSession, path: str, name: str, n: int, seconds: float) -> None:
    """One row: engine, patterns, seconds, seconds for a pattern."""
    spark.createDataFrame([(name, n, seconds, seconds / max(1, n))], "engine string, patterns long, seconds double, each double").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_stat(spark: SparkSession, stat: dict, path: str) -> None:
    """A map as YAML lines `key: value`."""
    rows = [(f"{k}: {v}",) for k, v in stat.items()]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def write_sample_counts(df: DataFrame, path: str) -> None:
    """query, true, est, q-error and what a sample's estimate rests on: n, m, k."""
    from ..operators.statistics import q_error

    df.select("query", "true", "est", q_error(F.col("true"), F.col("est")).alias("q-error"), "n", "m", "k").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def cached_ngrams(strings: DataFrame, folder: str, n: int, threshold: int = 1) -> DataFrame:
    """The n-gram table of the folder for n and a least count, made at the first call: the whole table once for each n, those of greater least counts from it."""
    from ..operators.statistics import ngram_table

    spark = strings.sparkSession
    whole, own = f"{folder}/ngrams-{n}", f"{folder}/ngrams-{n}-{threshold}"

    def there(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    if not there(whole):
        ngram_table(strings, n).write.mode("overwrite").parquet(whole)
    if threshold <= 1:
        return spark.read.parquet(whole)
    if not there(own):
        spark.read.parquet(whole).where(F.col("cnt") >= threshold).write.mode("overwrite").parquet(own)
    return spark.read.parquet(own)


def write_sqlite(df: DataFrame, path: str, table: str = "labels") -> int:
    """A labelled workload (pattern, card) as a table of an SQLite file, for tools that read those; rows come to the driver a partition at a time. Returns how many."""
    import sqlite3

    n = 0
    with sqlite3.connect(path) as con:
        con.execute(f'DROP TABLE IF EXISTS "{table}"')
        con.execute(f'CREATE TABLE "{table}" (pattern TEXT PRIMARY KEY, card INTEGER)')
        for r in df.select("pattern", "card").toLocalIterator():
            con.execute(f'INSERT INTO "{table}" VALUES (?, ?)', (r["pattern"], r["card"]))
            n += 1
    con.close()
    return n


def sqlite(spark: SparkSession, path: str, table: str = "labels") -> DataFrame:
    """The table of an SQLite file: pattern, card. The file is one machine's, and read by its driver."""
    import sqlite3

    con = sqlite3.connect(path)
    rows = con.execute(f'SELECT pattern, card FROM "{table}"').fetchall()
    con.close()
    return spark.createDataFrame(rows, "pattern string, card long")


def write_batches(df: DataFrame, path: str, key: str, batch: int) -> None:
    """Rows as Parquet by batches of about `batch` rows, dealt by a hash of the key (column batch)."""
    n = max(1, -(-df.count() // batch))
    df.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).write.mode("overwrite").partitionBy("batch").parquet(path)


def batch(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One batch; the others aren't read."""
    return spark.read.parquet(path).where(F.col("batch") == number).drop("batch")


def readable(column: str, how: str = "replace") -> Column:
    """Bytes as text: invalid UTF-8 replaced by the replacement sign, or (how `null`) null where there is any."""
    return F.expr({"replace": "make_valid_utf8", "null": "try_validate_utf8"}[how] + f"(cast(`{column}` as string))")


def valid_utf8(column: str) -> Column:
    """Whether bytes are UTF-8."""
    return F.expr(f"is_valid_utf8(cast(`{column}` as string))")
