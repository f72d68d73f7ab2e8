"""Choice of a counting engine by what a pattern set looks like; all give the same counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import counting

#: Patterns up to which matching all strings with all patterns is cheapest.
FEW = 200


def choose(patterns: DataFrame):
    """naive for few patterns, typed if most have one token, positional where most have several, of which many may be shared; else candidates."""
    t = P.tokens(F.col("pattern"))
    row = patterns.agg(F.count("*").alias("n"), F.count_if(F.size(t) == 1).alias("one"), F.count_if((F.size(t) > 1) & (F.array_min(F.transform(t, F.length)) < counting.GRAM)).alias("short")).first()
    if row["n"] <= FEW:
        return counting.naive
    if row["one"] * 2 >= row["n"]:
        return counting.typed
    return counting.positional if row["short"] * 2 >= row["n"] else counting.candidates


def count(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    return choose(patterns)(strings, patterns)
