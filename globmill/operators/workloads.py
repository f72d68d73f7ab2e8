"""Pattern workloads from strings: enumerated ones, and drawn ones.

Draws are by md5 of a seed, a purpose and the row, compared as hexadecimal text, so that every run and engine makes the
same ones. strings: s, w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import words as X
from . import statistics as S

def draw(purpose: str, *of: Column) -> Column:
    """32 bits as 8 hexadecimal digits."""
    return F.substring(F.md5(F.concat_ws("-", F.lit(purpose), *[c.cast("string") for c in of]).cast("binary")), 1, 8)


def _below(share: float) -> Column:
    return F.lit(f"{min(int(share * 2**32), 2**32 - 1):08x}")


def _first(items: Column, n: Column, purpose: str, *of: Column) -> Column:
    """n of the items by draw, in their own order."""
    drawn = F.array_sort(F.transform(items, lambda x, i: F.struct(draw(purpose, *of, i).alias("h"), i.alias("i"), x.alias("x"))))
    kept = F.array_sort(F.transform(F.slice(drawn, F.lit(1), n), lambda t: F.struct(t["i"].alias("i"), t["x"].alias("x"))))
    return F.transform(kept, lambda t: t["x"])


def _grams(s: Column, most: Column) -> Column:
    """All substrings of up to `most` characters with their place: at, g."""
    n = F.length(s)
    return F.when((n >= 1) & (most >= 1), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(most, n - i + 1))), lambda k: F.struct(i.alias("at"), F.substr(s, i, k).alias("g")))))).otherwise(F.array().cast("array<struct<at:int,g:string>>"))


def _wrap(*parts: Column) -> Column:
    p = F.lit("%")
    return F.concat(p, *[y for x in parts for y in (x, p)])


def _once(c: Column) -> Column:
    """A column that later filters refer to: as a generator's output it isn't copied into them."""
    return F.explode(F.array(c))


def data_strings(strings: DataFrame) -> DataFrame:
    """Distinct strings to make patterns of: not empty and without wildcards."""
    return strings.where((F.col("s") != "") & ~F.col("s").rlike("[%_]")).select("s").distinct()


def words(strings: DataFrame) -> DataFrame:
    return strings.select(F.explode(F.split("s", r"\s+")).alias("word")).where("word <> ''").distinct()


def word_counts(strings: DataFrame) -> DataFrame:
    """word, card: records that hold each word."""
    return strings.select("w", F.explode(F.array_distinct(F.split("s", r"\s+"))).alias("word")).where("word <> ''").groupBy("word").agg(F.sum("w").alias("card"))


def of_words(strings: DataFrame, way: str, most: int) -> DataFrame:
    """All patterns of one part of up to `most` characters of a word: substring, prefix or suffix."""
    w, p = F.col("word"), F.lit("%")
    upto = F.sequence(F.lit(1), F.least(F.lit(most), F.length(w)))
    parts = {
        "substring": F.transform(_grams(w, F.lit(most)), lambda g: _wrap(g["g"])),
        "prefix": F.transform(upto, lambda n: F.concat(F.substr(w, F.lit(1), n), p)),
        "suffix": F.transform(upto, lambda n: F.concat(p, F.right(w, n))),
    }[way]
    return words(strings).select(F.explode(parts).alias("pattern")).distinct()


def two_in_word(strings: DataFrame, longest: int) -> DataFrame:
    """`%a%` and `%a%b%` of up to `longest` characters, b after a in the same word."""
    one = words(strings).select("word", F.explode(_grams(F.col("word"), F.lit(longest - 2))).alias("a"))
    rest = F.substr("word", F.col("a.at") + F.length("a.g"))
    second = _grams(rest, F.lit(longest - 3) - F.length("a.g"))
    two = one.select("a", F.explode(second).alias("b")).select(_wrap(F.col("a.g"), F.col("b.g")).alias("pattern"))
    return one.select(_wrap(F.col("a.g")).alias("pattern")).union(two).distinct()


def two_of_pair(strings: DataFrame, longest: int) -> DataFrame:
    """`%a%b%` of up to `longest` characters, a and b of two words in their order. Distinct word pairs first, then their parts."""
    w = F.filter(F.split("s", r"\s+"), lambda x: x != "")
    x = strings.select(w.alias("ws")).where(F.size("ws") > 1).select("ws", F.posexplode("ws").alias("i", "first"))
    x = x.select("first", F.explode(F.slice("ws", F.col("i") + 2, F.size("ws"))).alias("second")).distinct()
    x = x.select("second", F.explode(_grams(F.col("first"), F.lit(longest - 4))).alias("a"))
    x = x.select("a", F.explode(_grams(F.col("second"), F.lit(longest - 3) - F.length("a.g"))).alias("b"))
    return x.select(_wrap(F.col("a.g"), F.col("b.g")).alias("pattern")).distinct()


def cut_long_words(strings: DataFrame, longest: int, repeat: int = 1) -> DataFrame:
    """`%head%tail%` of words that are too long for a pattern of `longest` characters: a drawn stretch of them is left out."""
    room = longest - 3
    x = words(strings).where(F.length("word") > room).select("word", F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("r"))
    pick = lambda items, purpose: F.element_at(_first(items, F.lit(1), purpose, F.col("word"), F.col("r")), 1)
    x = x.withColumn("i", pick(F.sequence(F.lit(1), F.lit(room - 1)), "head"))
    x = x.withColumn("j", pick(F.sequence(F.col("i"), F.lit(room - 1)), "tail"))
    return x.select(_wrap(F.substr("word", F.lit(1), F.col("i")), F.right("word", F.lit(room) - F.col("j"))).alias("pattern")).distinct()


def n_words(strings: DataFrame, most: int, shortest: int = 2, longest: int = 10) -> DataFrame:
    """`%w1%..%wn%` of one to `most` drawn words of each string, in their order."""
    x = strings.select("s", X.clean_words(F.filter(F.split("s", r"\s+"), lambda w: w != ""), shortest, longest).alias("ws")).where(F.size("ws") > 0)
    n = F.element_at(_first(F.sequence(F.lit(1), F.least(F.lit(most), F.size("ws"))), F.lit(1), "count", F.col("s")), 1)
    return x.select(_wrap(F.array_join(_first(F.col("ws"), n, "words", F.col("s")), "%")).alias("pattern")).distinct()


def _blurred(token: Column, most: int, *of: Column) -> Column:
    """Up to `most` characters as underscores; their number k is drawn with weights 1 / (k + 1)^2."""
    weights = [1 / (k + 1) ** 2 for k in range(most + 1)]
    h, k = draw("under", token, *of), F.lit(most)
    for i in range(most - 1, -1, -1):
        k = F.when(h < _below(sum(weights[: i + 1]) / sum(weights)), F.lit(i)).otherwise(k)
    at = _first(F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1))), k, "where", token, *of)
    return F.array_join(F.transform(F.split(token, ""), lambda c, i: F.when(F.array_contains(at, i + 1), "_").otherwise(c)), "")


def general(strings: DataFrame, tokens: int = 2, under: int = 2, shortest: int = 2, longest: int = 5) -> DataFrame:
    """pattern: the drawn patterns of general_kinds()."""
    return general_kinds(strings, tokens, under, shortest, longest).select("pattern").distinct()


def general_kinds(strings: DataFrame, tokens: int = 2, under: int = 2, shortest: int = 2, longest: int = 5) -> DataFrame:
    """kind, n, pattern. For each string and each number of tokens one drawn pattern: half of them substrings, a quarter prefixes, a quarter suffixes, with underscores."""
    s, p = F.col("s"), F.lit("%")
    x = data_strings(strings).withColumn("ws", X.edge_words(s)).where(F.size("ws") > 0)
    x = x.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(tokens)))).withColumn("h", draw("kind", s, F.col("n")))
    x = x.withColumn("kind", F.when(F.col("h") < "80000000", "SUBSTR").when(F.col("h") < "c0000000", "PREFIX").otherwise("SUFFIX"))
    fit = lambda a: F.filter(a, lambda w: F.length(w).between(shortest, longest))
    ws, n = F.col("ws"), F.col("n")
    inner = F.when(F.col("kind") == "SUBSTR", fit(ws)).when(F.col("kind") == "PREFIX", fit(F.slice(ws, F.lit(2), F.size(ws)))).otherwise(fit(F.slice(ws, F.lit(1), F.size(ws) - 1)))
    x = x.withColumn("inner", _once(inner)).withColumn("more", F.when(F.col("kind") == "SUBSTR", n).otherwise(n - 1)).where(F.size("inner") >= F.col("more"))
    chosen = _first(F.col("inner"), F.col("more"), "token", s, n)
    edge = F.when(F.col("kind") == "PREFIX", F.substr(F.element_at(ws, 1), F.lit(1), F.lit(longest))).otherwise(F.right(F.element_at(ws, -1), F.lit(longest)))
    x = x.withColumn("chosen", _once(chosen))
    chosen = F.col("chosen")
    x = x.withColumn("t", F.when(F.col("kind") == "SUBSTR", chosen).when(F.col("kind") == "PREFIX", F.concat(F.array(edge), chosen)).otherwise(F.concat(chosen, F.array(edge))))
    body = F.array_join(F.transform("t", lambda t, i: _blurred(t, under, s, n, i)), "%")
    q = F.when(F.col("kind") == "SUBSTR", F.concat(p, body, p)).when(F.col("kind") == "PREFIX", F.concat(body, p)).otherwise(F.concat(p, body))
    x = x.select("kind", "n", _once(P.canonical(q, True)).alias("q"))
    left, right = F.col("q").startswith("%"), F.col("q").endswith("%")
    x = x.where((left | (F.col("kind") == "PREFIX")) & (right | (F.col("kind") == "SUFFIX")) & (F.size(F.filter(F.split("q", "%"), lambda t: t != "")) == F.col("n")))
    return x.select("kind", "n", P.canonical(F.col("q")).alias("pattern")).distinct()


def with_tokens(candidates: DataFrame, m: int, *others: DataFrame) -> DataFrame:
    """Candidates of exactly m tokens that are in none of the others."""
    return without(candidates.where(F.size(P.tokens(F.col("pattern"))) == m), *others)


def uniform(candidates: DataFrame, distinct: int, share: float = 0.1, least: int = 500) -> DataFrame:
    """kind, n, pattern, split: as many patterns of each kind and number of tokens, dealt to test, valid and train.

    train has share * max(distinct, least) patterns of each group and valid and test a tenth of that; a group with fewer
    candidates has all three shrunk alike. candidates: kind, n, pattern (different ones). Drawn by md5, ranked in buckets.
    """
    n = max(distinct, least)
    train, rest = int(share * n), int(share / 10 * n)
    total = train + 2 * rest
    x = S.shuffled_rank(candidates, "pattern", by=["kind", "n"])
    cut = lambda k: F.when(F.col("total") >= total, F.lit(k)).otherwise(F.floor(F.lit(k) * F.col("total") / max(1, total)))
    x = x.withColumn("_test", cut(rest)).withColumn("_train", cut(train))
    r = F.col("rank")
    part = F.when(r < F.col("_test"), "test").when(r < 2 * F.col("_test"), "valid").when(r < 2 * F.col("_test") + F.col("_train"), "train")
    return x.select("kind", "n", "pattern", part.alias("split")).where("split is not null")


def clipped(x: DataFrame, column: str, share: float) -> DataFrame:
    """A share of the rows of each length, one at least: the first by md5. Rows are different in the column."""
    ranked = S.shuffled_rank(x.withColumn("_len", F.length(column)), column, by=["_len"])
    keep = F.floor(F.greatest(F.lit(share), F.lit(1.0) / F.col("total")) * F.col("total") + 1e-9)
    return ranked.where(F.col("rank") < keep).select(*x.columns)


def in_steps(patterns: DataFrame, train: bool = True) -> DataFrame:
    """pattern, step: a curriculum. Step 1 has the patterns of one part and the first part of longer ones, step 2 the longer ones (and, unless train, the others again)."""
    bare = F.filter(F.split(F.regexp_replace("pattern", "^%+|%+$", ""), "%+"), lambda x: x != "")
    x = patterns.select("pattern").distinct().withColumn("parts", bare)
    one = F.when(F.size("parts") <= 1, F.col("pattern")).otherwise(_wrap(F.get("parts", F.lit(0))))
    first = x.select(one.alias("pattern"), F.lit(1).alias("step"))
    second = (x.where(F.size("parts") > 1) if train else x).select("pattern", F.lit(2).alias("step"))
    return first.unionAll(second).distinct()


def split_union(strings: DataFrame, most: int = 4) -> DataFrame:
    """kind, pattern, card: the labelled prefix, suffix and substring patterns of all words as one workload."""
    from . import counting as C

    out = None
    for kind in ("prefix", "suffix", "substring"):
        x = C.typed(strings, of_words(strings, kind, most)).select(F.lit(kind).alias("kind"), "pattern", "card")
        out = x if out is None else out.unionByName(x)
    return out


def valid_instances(labelled: DataFrame, most: int, seed: str = "0") -> DataFrame:
    """At most `most` labelled patterns with matches, drawn by md5."""
    return S.shuffled_rank(labelled.where("card > 0"), "pattern", seed).where(F.col("rank") < most).select(*labelled.columns)


def random_wildcards(strings: DataFrame, seed: str = "0") -> DataFrame:
    """Drawn characters of each string give way: alone to `_`, beside another one to `%`. Each number of them is equally likely."""
    s, e = F.col("s"), F.lit(seed)
    hit = F.transform(F.split("s", ""), lambda c, i: draw("char", e, s, i) < draw("share", e, s))
    x = data_strings(strings).withColumn("hit", hit)
    near = lambda i: F.coalesce(F.get("hit", i - 1), F.lit(False)) | F.coalesce(F.get("hit", i + 1), F.lit(False))
    put = F.transform(F.split("s", ""), lambda c, i: F.when(~F.get("hit", i), c).when(near(i), "%").otherwise("_"))
    return x.select(F.regexp_replace(F.array_join(put, ""), "%+", "%").alias("pattern")).where("pattern <> '%'").distinct()


def by_shape(strings: DataFrame, shapes: DataFrame) -> DataFrame:
    """shape, pattern: one pattern a string for each shape (`%w%w%` and the like), with words cut to the shape's longest token. shapes: shape, low, high (a report's few rows).

    Tokens at an anchored edge are the string's own start or end; the others are drawn words of at least `low` characters.
    """
    sh = F.col("shape")
    # the shapes' table, however long, is one row that goes along with each string: shapes are a report's rows
    listed = shapes.agg(F.array_sort(F.collect_list(F.struct("shape", "low", "high"))).alias("_shapes"))
    x = data_strings(strings).crossJoin(F.broadcast(listed)).select("s", F.explode("_shapes").alias("x")).select("s", "x.*")
    left, right = sh.startswith("w").cast("int"), sh.endswith("w").cast("int")
    ws = F.filter(F.split("s", r"\s+"), lambda w: F.length(w) >= F.col("low"))
    x = x.withColumn("ws", ws).withColumn("m", F.length(F.regexp_replace("shape", "[^w]", ""))).withColumn("inner", F.col("m") - F.when(F.col("m") == 1, F.greatest(left, right)).otherwise(left + right))
    x = x.where((F.col("m") >= 1) & (sh != "w") & (F.size("ws") >= F.col("inner")) & (F.length("s") >= F.col("low")))
    mid = F.transform(_first(F.col("ws"), F.col("inner"), "shape", F.col("s"), sh), lambda w: F.substr(w, F.lit(1), F.col("high")))
    none = F.array().cast("array<string>")
    head = F.when(left == 1, F.array(F.substr("s", F.lit(1), F.col("high")))).otherwise(none)
    tail = F.when(right == 1, F.array(F.right("s", F.col("high")))).otherwise(none)
    t = F.concat(head, mid, tail)
    body = F.array_join(t, "%")
    return x.select("shape", F.concat(F.when(left == 0, "%").otherwise(""), body, F.when(right == 0, "%").otherwise("")).alias("pattern")).distinct()


def without(x: DataFrame, *others: DataFrame) -> DataFrame:
    """Patterns that are in none of the others."""
    for y in others:
        x = x.join(y.select("pattern").distinct(), "pattern", "left_anti")
    return x


def split_sizes(distinct: int, available: int, share: float = 0.1, least: int = 500) -> dict[str, int]:
    """Rows of train, valid and test for a number of distinct strings, shrunk alike where fewer candidates are there."""
    n = max(distinct, least)
    sizes = {"train": int(share * n), "valid": int(share / 10 * n), "test": int(share / 10 * n)}
    total = sum(sizes.values())
    return sizes if available >= total else {k: int(v * available / total) for k, v in sizes.items()}
