"""LIKE patterns as Column expressions: parsing, canonical forms, types, augmentations.

A pattern is runs of wildcards (`%` any run, `_` one code point; no escape sign) and runs of other characters (tokens).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "([%_]+|[^%_]+)"


def runs(q: Column) -> Column:
    """Alternating runs of wildcards and of other characters."""
    return F.regexp_extract_all(q, F.lit(RUN), F.lit(1))


def is_wild(r: Column) -> Column:
    return r.rlike("^[%_]")


def _underscores(r: Column) -> Column:
    return F.replace(r, F.lit("%"), F.lit(""))


def canonical(q: Column, flip: bool = False) -> Column:
    """Each wildcard run as one `%` (if it has any) and then its underscores; flip: the last run the other way round."""
    plain = F.transform(runs(q), lambda r: F.when(is_wild(r) & F.contains(r, F.lit("%")), F.concat(F.lit("%"), _underscores(r))).otherwise(r))
    out = F.array_join(plain, "")
    if not flip:
        return out
    tail = F.regexp_extract(out, "([%_]*)$", 1)
    turned = F.when(F.contains(tail, F.lit("%")), F.concat(_underscores(tail), F.lit("%"))).otherwise(tail)
    return F.concat(F.regexp_extract(out, "(?s)^(.*?)[%_]*$", 1), turned)


def tokens(q: Column) -> Column:
    return F.filter(runs(q), lambda r: ~is_wild(r))


def ops(q: Column) -> Column:
    """Wildcard runs o_0 .. o_m around the m tokens; empty ones at the edges where a token stands there."""
    r = runs(q)
    lead = F.when((F.size(r) == 0) | is_wild(F.get(r, F.lit(0))), F.array().cast("array<string>")).otherwise(F.array(F.lit("")))
    trail = F.when((F.size(r) == 0) | is_wild(F.get(r, F.size(r) - 1)), F.array().cast("array<string>")).otherwise(F.array(F.lit("")))
    return F.concat(lead, F.filter(r, is_wild), trail)


def interior_ops(q: Column) -> Column:
    return F.slice(ops(q), F.lit(2), F.greatest(F.size(tokens(q)) - 1, F.lit(0)))


def kind(q: Column) -> Column:
    """SUBSTR, PREFIX, SUFFIX or EXACT, by where `%` stands at the edges."""
    a, b = q.startswith("%"), q.endswith("%")
    return F.when(a & b, "SUBSTR").when(b, "PREFIX").when(a, "SUFFIX").otherwise("EXACT")


def shape(q: Column) -> Column:
    return F.regexp_replace(q, "[^%_]+", "w")


def prefixes(q: Column) -> Column:
    """All prefixes, shortest first."""
    return F.when(F.length(q) > 0, F.transform(F.sequence(F.lit(1), F.length(q)), lambda i: F.substr(q, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def suffixes(q: Column) -> Column:
    return F.transform(prefixes(F.reverse(q)), F.reverse)


def parts_upto(s: Column, most: int) -> Column:
    """All different substrings of up to `most` characters."""
    n = F.length(s)
    at = lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(most), n - i + 1))), lambda k: F.substr(s, i, k))
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)))).otherwise(F.array().cast("array<string>"))


def prefixes_upto(s: Column, most: int) -> Column:
    n = F.least(F.length(s), F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(s, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def suffixes_upto(s: Column, most: int) -> Column:
    n = F.least(F.length(s), F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.right(s, k))).otherwise(F.array().cast("array<string>"))


def delimiter(q: Column, unique: bool = False, trim: bool = False) -> Column:
    """Each prefix with a `%` at its end. unique: prefixes that end with one already are left out, but for a leading `%`; trim: the whole pattern's own is left out (suffix patterns, which end without a `%`)."""
    ended = lambda p: F.when(p.endswith("%"), p).otherwise(F.concat(p, F.lit("%")))
    parts = prefixes(q)
    if unique:
        parts = F.filter(parts, lambda p: ~p.endswith("%") | (p == "%"))
    out = F.transform(parts, ended)
    return F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))) if trim else out


def augmented(q: Column) -> Column:
    """All augmentations of a pattern, sorted: prefixes, prefixes with a `%`, placeholders, and sub-patterns."""
    return F.array_sort(F.array_distinct(F.concat(prefixes(q), delimiter(q), placeholder(q), packed(q))))


def wildcard_runs(q: Column) -> Column:
    """The different wildcard runs of a pattern, sorted: alphabets of models that read a run as one sign."""
    return F.array_sort(F.array_distinct(F.filter(runs(q), is_wild)))


def sort_key(q: Column) -> Column:
    """Numbers whose order puts wildcards before characters, `%` before `_`, and characters by descending code point; a pattern comes before those that go on from it."""
    code = lambda ch: F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int")
    return F.transform(F.filter(F.split(q, ""), lambda ch: ch != ""), lambda ch: F.when(ch == "%", F.lit(-2)).when(ch == "_", F.lit(-1)).otherwise(F.lit(0x110000) - code(ch)))


def placeholder(q: Column) -> Column:
    """Characters revealed one by one, the others as underscores; in the last wildcard run only its last `%` stays."""

    def step(i: Column) -> Column:
        masked = F.concat(F.substr(q, F.lit(1), i), F.regexp_replace(F.substr(q, i + 1), "[^%]", "_"))
        tail = F.regexp_extract(masked, "([%_]*)$", 1)
        last = F.length(tail) - F.locate("%", F.reverse(tail)) + 1
        kept = F.when(F.contains(tail, F.lit("%")), F.concat(_underscores(F.substr(tail, F.lit(1), last - 1)), F.lit("%"), F.substr(tail, last + 1))).otherwise(tail)
        return F.concat(F.regexp_extract(masked, "(?s)^(.*?)[%_]*$", 1), kept)

    return F.when(F.length(q) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), step)).otherwise(F.array().cast("array<string>"))


def packed(q: Column, mode: str = "simple", way: str = "forward") -> Column:
    """Sub-patterns: simple (prefixes of the flipped form), normal (of the plain one), core (of the pattern without its edge `%`, as substring, prefix and suffix); forward, backward or both."""
    whole = {"simple": canonical(q, True), "normal": canonical(q), "core": F.regexp_replace(q, "^%+|%+$", "")}[mode]
    parts = {"forward": prefixes(whole), "backward": suffixes(whole), "both": F.concat(prefixes(whole), suffixes(whole))}[way]
    if mode == "core":
        bare = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^%+|%+$", "")), lambda p: p != "")
        p = F.lit("%")
        parts = F.flatten(F.transform(bare, lambda t: F.array(F.concat(p, t, p), F.concat(t, p), F.concat(p, t))))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda t: canonical(t))))


def like(s: str, q: str) -> Column:
    """s LIKE q without escape signs: Spark's own one is doubled."""
    return F.expr(f"{s} LIKE replace({q}, '\\\\', '\\\\\\\\')")


def occurrences(s: Column, t: Column) -> Column:
    """Positions (from 1) of a token, overlapping ones too."""
    n = F.length(s) - F.length(t) + 1
    at = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda p: F.substr(s, p, F.length(t)) == t)


def conditional_steps(q: Column) -> Column:
    """The chain of patterns that reads a canonical pattern from left to right, one character or tightened gap a step."""
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("gap"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, ch: Column) -> Column:
        wild = (ch == "%") | (ch == "_")
        loose = F.concat(F.when(state["done"] == "", F.lit("%")).otherwise(F.concat(state["done"], F.lit("%"))), ch, F.lit("%"))
        tight = F.concat(state["done"], state["gap"], ch)
        steps = F.when(state["gap"] == "%", F.array(loose)).otherwise(F.array(loose, F.concat(tight, F.lit("%"))))
        return F.struct(
            F.when(wild, state["done"]).otherwise(tight).alias("done"),
            F.when(wild, F.concat(state["gap"], ch)).otherwise(F.lit("")).alias("gap"),
            F.when(wild, state["out"]).otherwise(F.concat(state["out"], steps)).alias("out"),
        )

    end = F.aggregate(F.filter(F.split(q, ""), lambda ch: ch != ""), empty, add)
    return F.when(end["gap"] == "%", end["out"]).otherwise(F.concat(end["out"], F.array(q)))
