"""Exact counts of strings by pattern. strings: s, w (distinct strings with weights); patterns: pattern. Result: pattern, card.

Every engine gives the same counts and keeps patterns without a match, with 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P

#: Rows and bytes of patterns up to which they are broadcast; checked, as broadcasts must not grow with the data.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 4 << 20
#: The same where a row is found by an equal key, so that not every string meets every pattern.
KEYED_ROWS, KEYED_BYTES = 100_000, 8 << 20
#: Parts into which a token's strings are dealt where patterns are joined by a shuffle.
SALTS = 16
GRAM = 3


def weighted(df: DataFrame, column: str) -> DataFrame:
    """Distinct strings with their number of rows; null counts as the empty string."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("")).alias("s")).agg(F.count("*").alias("w"))


def _all(patterns: DataFrame, hits: DataFrame) -> DataFrame:
    got = hits.groupBy("pattern").agg(F.sum("w").alias("card"))
    return patterns.select("pattern").distinct().join(got, "pattern", "left").select("pattern", F.coalesce("card", F.lit(0)).cast("long").alias("card"))


def small(x: DataFrame, column: str, keyed: bool = False) -> bool:
    """Whether a table with a text column may be broadcast, by its rows and the bytes of that column."""
    rows, most = (KEYED_ROWS, KEYED_BYTES) if keyed else (BROADCAST_ROWS, BROADCAST_BYTES)
    n, size = x.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return n <= rows and size <= most


def spread(df: DataFrame) -> DataFrame:
    """Dealt over all partitions that a shuffle has: few bytes may be much work, where sizes alone would make it one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def naive(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every string with every pattern: for small pattern sets, which are broadcast after a check of their size. Larger ones go by lengths: patterns of wildcards alone by lengths of strings, the others by each string's characters."""
    p = patterns.select("pattern").distinct()
    if not small(p, "pattern"):
        return by_parts(strings, p)
    # the longest token is looked for first: that needs no expression to be compiled
    told = p.withColumn("_t", longest(F.col("pattern")))
    return _all(p, spread(strings).join(F.broadcast(told), F.contains(F.col("s"), F.col("_t")) & P.like("s", "pattern")))


def longest(q) -> Column:
    """The longest token of a pattern (of several, the first), or the empty string."""
    t = F.transform(P.tokens(q), lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.coalesce(F.array_min(t)["t"], F.lit(""))


def anchored(q: Column) -> Column:
    """Of a pattern's tokens, longest first (of equal ones, those at an edge without wildcards): t, and at: 1 where a string has to begin with it, 2 where it has to end with it, else 0."""
    tokens = P.tokens(q)
    wild = lambda edge: edge.isin("%", "_")
    at = lambda i: F.when((i == 0) & ~wild(F.left(q, F.lit(1))), 1).when((i == F.size(tokens) - 1) & ~wild(F.right(q, F.lit(1))), 2).otherwise(0)
    return F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("n"), (at(i) == 0).alias("loose"), i.alias("i"), at(i).alias("at"), t.alias("t"))))


def holders(strings: DataFrame, patterns: DataFrame, edges: bool = True) -> DataFrame:
    """The columns of patterns (which have tokens) with s, w of the strings that hold their two longest tokens, the longest one at its edge if it has one (edges: false takes them anywhere).

    An equality join on the parts of strings at the places and of the lengths that such tokens have. Small pattern sets are
    broadcast, so pairs are made and tested where the strings are; larger ones are joined by token and a salt of the string.
    """
    p = patterns.withColumn("_best", anchored(F.col("pattern")))
    best, other = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    p = p.select(*patterns.columns, best["t"].alias("_token"), (best["at"] if edges else F.lit(0)).alias("_at"), F.coalesce(other["t"], F.lit("")).alias("_other"))
    sizes = p.select("_at", F.length("_token").alias("_n")).distinct()  # as many rows as there are places and lengths of tokens
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - F.col("_n") + 1), lambda i: F.substr(F.col("s"), i, F.col("_n"))))
    parts = F.when(F.col("_at") == 1, F.array(F.left("s", "_n"))).when(F.col("_at") == 2, F.array(F.right("s", "_n"))).otherwise(parts)
    held = spread(strings).join(F.broadcast(sizes), F.length("s") >= F.col("_n")).select("s", "w", "_at", F.explode(parts).alias("_token"))
    key = ["_at", "_token"]
    if small(patterns, "pattern", keyed=True):
        pairs = held.join(F.broadcast(p), key)
    else:
        held = held.withColumn("_salt", F.pmod(F.xxhash64("s"), F.lit(SALTS)))
        pairs = held.join(p.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*key, "_salt"])
    return pairs.where(F.contains(F.col("s"), F.col("_other"))).select(*patterns.columns, "s", "w")


def bare(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns of wildcards alone: by the number of their underscores and the strings' lengths, of which there are few."""
    q = P.canonical(F.col("pattern"))
    p = patterns.select("pattern").distinct().select("pattern", F.length(F.replace(q, F.lit("%"), F.lit(""))).alias("n"), F.contains(q, F.lit("%")).alias("open"))
    lengths = strings.groupBy(F.length("s").alias("n")).agg(F.sum("w").alias("w"))
    # for each length that occurs, the weight of it and of all from it on
    lengths = lengths.withColumn("up", F.sum("w").over(W.orderBy(F.desc("n"))))
    exact = p.where("not open").join(lengths, "n", "left").select("pattern", F.coalesce("w", F.lit(0)).alias("w"))
    asked = p.where("open").select("n").distinct()
    reach = asked.withColumn("w", F.lit(None).cast("long")).unionAll(lengths.select("n", "up"))
    reach = reach.groupBy("n").agg(F.max("w").alias("w")).withColumn("w", F.first("w", ignorenulls=True).over(W.orderBy("n").rowsBetween(0, W.unboundedFollowing)))
    opened = p.where("open").join(reach, "n").select("pattern", F.coalesce("w", F.lit(0)).alias("w"))
    return _all(p, exact.unionAll(opened))


def by_parts(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Strings that hold a pattern's longest token, then LIKE; wildcards alone by lengths. No string meets all patterns."""
    p = patterns.select("pattern").distinct()
    some = p.where(F.col("pattern").rlike("[^%_]"))
    hits = holders(strings, some).where(P.like("s", "pattern")).select("pattern", "w")
    return _all(some, hits).unionAll(bare(strings, p.where(~F.col("pattern").rlike("[^%_]"))))


def grams(s, n: int = GRAM):
    """Distinct n-grams of a string."""
    m = F.length(s) - n + 1
    return F.when(m >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.substr(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def candidates(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Strings that share the rarest gram of a pattern, then LIKE. Patterns without a token of GRAM characters go to by_parts()."""
    p = patterns.select("pattern").distinct()
    own = p.select("pattern", F.explode(F.flatten(F.transform(P.tokens(F.col("pattern")), lambda t: grams(t)))).alias("gram"))
    index = spread(strings).select("s", "w", F.explode(grams(F.col("s"))).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(frequency, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram"))["gram"].alias("gram"))
    hits = spread(index.join(rarest, "gram")).where(P.like("s", "pattern")).select("pattern", "w")
    return _all(rarest, hits).unionAll(by_parts(strings, p.join(rarest, "pattern", "left_anti")))


def typed(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Exact, prefix and suffix patterns with one token by equal keys; the others by candidates().

    A string's sides are cut at the lengths that the patterns' tokens have, not at all of its own.
    """
    p = patterns.select("pattern").distinct()
    q, t = F.col("pattern"), P.tokens(F.col("pattern"))
    told = p.withColumn("kind", F.when((F.size(t) == 1) & (P.canonical(q) == q) & ~F.contains(q, F.lit("_")), P.kind(q)).otherwise("OTHER")).withColumn("token", F.get(t, F.lit(0)))
    keyed = told.where("kind IN ('EXACT', 'PREFIX', 'SUFFIX')")
    sizes = keyed.select("kind", F.length("token").alias("n")).distinct()  # as many rows as there are kinds and lengths of tokens
    fits = (F.length("s") >= F.col("n")) & ((F.col("kind") != "EXACT") | (F.length("s") == F.col("n")))
    side = F.when(F.col("kind") == "SUFFIX", F.right("s", F.col("n"))).otherwise(F.substr("s", F.lit(1), F.col("n")))
    sides = strings.join(F.broadcast(sizes), fits).select("w", "kind", side.alias("token")).groupBy("kind", "token").agg(F.sum("w").alias("w"))
    return _all(keyed, keyed.join(sides, ["kind", "token"])).unionAll(candidates(strings, told.where("kind IN ('OTHER', 'SUBSTR')")))


def postings(strings: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, s, w, pos (ascending positions, from 1) of the tokens of a workload alone. Further columns of strings come along."""
    lengths = tokens.select("token").distinct().withColumn("n", F.length("token"))
    sizes = lengths.select("n").distinct()  # as many rows as there are lengths of tokens
    places = F.transform(F.sequence(F.lit(1), F.length("s") - F.col("n") + 1), lambda p: F.struct(F.substr(F.col("s"), p, F.col("n")).alias("token"), p.alias("p")))
    windows = strings.join(F.broadcast(sizes), F.length("s") >= F.col("n")).select(*strings.columns, F.explode(places).alias("x"))
    windows = windows.select(*strings.columns, "x.token", "x.p").join(lengths.select("token"), "token", "left_semi")
    return windows.groupBy("token", *strings.columns).agg(F.array_sort(F.collect_list("p")).alias("pos"))


def positional(strings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Joins of position lists, token by token; patterns with the same number of tokens and the same first tokens share them, and strings without a position left drop out.

    Before a `%`, only the least position counts; otherwise all positions at the exact distance go on. A string's lists are made
    where it is, of the tokens that may come next, so neither lists nor pairs go through a shuffle. Patterns are broadcast,
    more than the keyed bound in as many groups as are needed; those without wildcards meet the string that equals them.
    """
    p = patterns.select("pattern").distinct().withColumn("q", P.canonical(F.col("pattern")))
    p = p.withColumn("t", P.tokens(F.col("q"))).withColumn("o", P.ops(F.col("q"))).withColumn("m", F.size("t"))
    plain = bare(strings, p.where("m = 0")).select("pattern", F.col("card").alias("w"))
    wild = F.col("pattern").rlike("[%_]")
    done = plain.unionAll(p.where((F.col("m") > 0) & ~wild).join(strings, F.col("pattern") == F.col("s")).select("pattern", "w"))
    some, dealt = p.where((F.col("m") > 0) & wild), spread(strings.select("s", "w"))
    told = some.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.octet_length("pattern")).alias("size")).collect()  # as many rows as there are numbers of tokens
    for r in sorted(told):
        groups = max(-(-r["n"] // max(KEYED_ROWS, 1)), -(-r["size"] // max(KEYED_BYTES, 1)))
        for g in range(groups):
            own = some.where((F.col("m") == r["m"]) & (F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g))
            done = done.unionAll(_chained(dealt, own, r["m"]))
    return _all(p, done)


def _chained(strings: DataFrame, patterns: DataFrame, m: int) -> DataFrame:
    """pattern, w of the strings that match patterns (pattern, t, o) of m tokens each, which are broadcast.

    after: the places behind the tokens so far, the least one alone where a `%` comes next. Each step cuts a string at the places
    that the next tokens may have and finds them by an equal key; the last one knows the run at the end, so a token that has
    to stand there is looked for there alone.
    """
    under = lambda o: F.length(F.replace(o, F.lit("%"), F.lit("")))
    free = lambda o: F.contains(o, F.lit("%"))
    op, token = lambda k: F.get("o", F.lit(k)), lambda k: F.get("t", F.lit(k))
    head = lambda k: F.concat_ws("\0", *[F.concat(op(i), F.lit("\1"), token(i)) for i in range(k + 1)])
    key = ["up", "op", "tail", "token"]
    x = strings.select("s", "w", F.length("s").alias("len"), F.lit("").alias("up"), F.array(F.lit(1)).alias("after"))
    for k in range(m):
        last = k == m - 1
        edges = patterns.select((head(k - 1) if k else F.lit("")).alias("up"), op(k).alias("op"), (op(m) if last else F.lit("%")).alias("tail"), token(k).alias("token"), head(k).alias("path"), (~free(op(k + 1))).alias("all"), "pattern")
        edges = edges.select(*key, "pattern") if last else edges.groupBy(*key, "path").agg(F.bool_or("all").alias("all"))
        n = F.length("token")
        sizes = edges.select("up", "op", "tail", n.alias("n"), under(F.col("op")).alias("under"), free(F.col("op")).alias("free"), (n + under(F.col("tail"))).alias("rest"), free(F.col("tail")).alias("loose")).distinct()
        x = x.join(F.broadcast(sizes), "up").withColumn("low", F.array_min("after") + F.col("under")).withColumn("high", F.col("len") + 1 - F.col("rest")).where("low <= high")
        begins = F.when(~F.col("free"), F.col("after")).when(F.col("loose"), F.sequence(F.col("low") - F.col("under"), F.greatest("low", "high") - F.col("under"))).otherwise(F.array(F.col("high") - F.col("under")))
        x = x.select("*", F.explode(begins).alias("v")).withColumn("at", F.col("v") + F.col("under")).where(F.when(F.col("loose"), F.col("at") <= F.col("high")).otherwise(F.col("at") == F.col("high")))
        x = x.withColumn("token", F.substr(F.col("s"), F.col("at"), F.col("n")))
        # of the places of one token, the first goes on; asked of the pattern's token, so that it is only asked of pairs
        same = lambda v: F.substr(F.col("s"), v, F.col("n")) == F.col("found")
        least = F.array_min(F.filter("after", lambda v: same(v + F.col("under")))) == F.col("v")
        first = F.when(~F.col("loose"), True).when(F.col("free"), F.position(F.col("found"), F.col("s"), F.col("low")) == F.col("at")).when(F.size("after") == 1, True).otherwise(least)
        x = x.join(F.broadcast(edges.withColumn("found", F.col("token"))), key).where(first)
        if last:
            return x.select("pattern", "w")
        places = F.when(F.col("free"), F.sequence("low", F.greatest("low", "high"))).otherwise(F.transform("after", lambda v: v + F.col("under")))
        after = F.when(F.col("all"), F.transform(F.filter(places, same), lambda v: v + F.col("n"))).otherwise(F.array(F.col("at") + F.col("n")))
        x = x.select("s", "w", "len", F.col("path").alias("up"), after.alias("after"))


def reverse_both(strings: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    return strings.withColumn("s", F.reverse("s")), patterns.withColumn("pattern", F.reverse("pattern"))


def prefix_cards(strings: DataFrame, patterns: DataFrame, engine=typed, form=P.canonical) -> DataFrame:
    """pattern, prefix_len, card: the count of every prefix of the canonical form. Prefixes that patterns share are counted once."""
    x = patterns.select("pattern").distinct().select("pattern", F.posexplode(P.prefixes(form(F.col("pattern")))).alias("i", "prefix"))
    cards = engine(strings, x.select(F.col("prefix").alias("pattern"))).withColumnRenamed("pattern", "prefix")
    return x.join(cards, "prefix").select("pattern", (F.col("i") + 1).alias("prefix_len"), "card")


def suffix_cards(strings: DataFrame, patterns: DataFrame, engine=typed) -> DataFrame:
    """The same of every suffix: both sides reversed."""
    s, p = reverse_both(strings, patterns.select(P.canonical(F.col("pattern")).alias("pattern")).distinct())
    return prefix_cards(s, p, engine, lambda q: q).select(F.reverse("pattern").alias("pattern"), F.col("prefix_len").alias("suffix_len"), "card")


def both_cards(strings: DataFrame, patterns: DataFrame, engine=typed) -> DataFrame:
    """pattern, card: the counts of all prefixes and all suffixes of the canonical forms, each once."""
    q = patterns.select(P.canonical(F.col("pattern")).alias("pattern")).distinct()
    parts = q.select(F.explode(F.concat(P.prefixes(F.col("pattern")), P.suffixes(F.col("pattern")))).alias("pattern")).distinct()
    return engine(strings, parts)
