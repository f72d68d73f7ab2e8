"""License scans by diagonal voting, in DataFrame functions alone.

Every text's words are joined, pair by rolling pair, with the places of such pairs in the templates (hash join; the
words themselves are compared too, so a shared hash is no vote). A pair at word p of the text and q of the template
votes for the diagonal p - q. Votes are summed by diagonal as a bit mask of template places, neighbouring diagonals
(words put in or left out) are merged into spans, and a span counts if enough of its template's places voted. A base
phrase needs all of them on one diagonal: its words then stand one after another.

The templates are a fixed list (under 200 pairs), so the broadcast doesn't grow. A template has 64 words at most.

Defined results: null texts are empty, with no words and no labels; a phrase that repeats counts at every place;
repeated rows get the same result each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

# The base phrases with their labels, then opening lines and notices of public licences.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
NOTICES = [
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-release", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: Share of a notice's places that must vote, and how far apart merged diagonals may lie.
ENOUGH, APART = 0.85, 2

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text in lower case. Lower case beyond A-Z changes no match: templates are ASCII, and the one sign whose lower case is ASCII is put aside."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))), _SEPARATORS), "")


def templates(spark: SparkSession) -> DataFrame:
    """Rows t (number), base, label, places (votes there are), q, a, b (the two words there), gram."""
    rows = [(t, t < len(BASE), label, len(w) - 1, q, w[q], w[q + 1]) for t, (label, text) in enumerate([*BASE, *NOTICES]) for w in [text.split(" ")] for q in range(len(w) - 1)]
    x = spark.createDataFrame(rows, "t int, base boolean, label string, places int, q int, a string, b string")
    return x.withColumn("gram", F.xxhash64("a", "b"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All spans found: key, text_hash, label, base, start and end (words, end exclusive), votes, coverage."""
    w = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("words"))
    pair = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.struct(F.xxhash64(a, b).alias("gram"), a.alias("a"), b.alias("b")))
    pairs = w.select("key", "text_hash", F.posexplode(pair).alias("p", "x")).select("key", "text_hash", "p", F.col("x.gram").alias("gram"), F.col("x.a").alias("wa"), F.col("x.b").alias("wb"))
    t = F.broadcast(templates(docs.sparkSession))
    hits = pairs.join(t, "gram").where((F.col("wa") == F.col("a")) & (F.col("wb") == F.col("b")))
    votes = hits.groupBy("key", "text_hash", "t", "base", "label", "places", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.expr("bit_or(shiftleft(1L, q))").alias("mask"), F.min("p").alias("start"), (F.max("p") + 2).alias("end")
    )
    own = W.partitionBy("key", "text_hash", "t").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(own)
    votes = votes.withColumn("_new", F.when(F.col("base") | gap.isNull() | (gap > APART), 1).otherwise(0))
    votes = votes.withColumn("_span", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    merged = votes.groupBy("key", "text_hash", "t", "base", "label", "places", "_span").agg(F.expr("bit_count(bit_or(mask))").alias("votes"), F.min("start").alias("start"), F.max("end").alias("end"))
    merged = merged.withColumn("coverage", F.col("votes") / F.col("places"))
    return merged.where(F.when(F.col("base"), F.col("votes") == F.col("places")).otherwise(F.col("coverage") >= ENOUGH)).drop("t", "places", "_span")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    join = lambda only: F.array_join(F.array_sort(F.collect_set(only)), ",")
    base = F.col("base")
    found = spans(docs).groupBy("key", "text_hash").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        join(F.when(base, F.col("label"))).alias("base_labels"),
        join(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(found, (F.col("doc_id") == F.col("key")) & (sized["text_hash"] == found["text_hash"]), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


_VALUES = ", ".join(f"({t}, {str(t < len(BASE)).lower()}, '{label}', '{text}')" for t, (label, text) in enumerate([*BASE, *NOTICES]))
SQL = rf"""
WITH t0(t, base, label, phrase) AS (VALUES {_VALUES}),
t1 AS (SELECT t, base, label, string_split(phrase, ' ') AS w FROM t0),
t2 AS (SELECT t, base, label, w, len(w) - 1 AS places, unnest(range(len(w) - 1)) AS q FROM t1),
tpl AS (SELECT t, base, label, places, q, w[q + 1] AS a, w[q + 2] AS b FROM t2),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 0))) AS p FROM d),
h AS (
  SELECT doc_id, t, base, label, places, p - q AS diagonal, bit_or(1::BIGINT << q::INT) AS mask, min(p) AS s
  FROM p JOIN tpl ON p.w[p.p + 1] = a AND p.w[p.p + 2] = b GROUP BY ALL),
g AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS gap FROM h),
n AS (SELECT *, sum(CASE WHEN base OR gap IS NULL OR gap > {APART} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM g),
m AS (SELECT doc_id, t, base, label, places, span, bit_count(bit_or(mask)) AS votes, min(s) AS s FROM n GROUP BY ALL),
k AS (SELECT *, votes / places::DOUBLE AS coverage FROM m WHERE CASE WHEN base THEN votes = places ELSE votes / places::DOUBLE >= {ENOUGH} END),
f AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (doc_id)
"""
