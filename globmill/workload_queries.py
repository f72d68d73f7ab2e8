"""Registered queries of pattern workloads, the reading language and text helpers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import language as L
from .functions import patterns as P
from .functions import words as X
from .operators import counting as C
from .operators import hybrid as H
from .operators import lbs
from .operators import statistics as S
from .operators import workloads as W
from .plans import features
from .queries import GRAMS, _A, _B, _EST, _NGRAM, _P, _S, _TOK, _bound_sql, _canon, _estimates, _project, patterns, query, read, strings, token_sentences, views

_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(p_name, '\\S+')) AS word FROM part)"
_GRAMS = "g AS (SELECT word, i, n, substr(word, i, n) AS g FROM (SELECT word, i, unnest(range(1, length(word) - i + 2)) AS n FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)))"

for _way, _form in (("substring", "'%' || g || '%'"), ("prefix", "g || '%'"), ("suffix", "'%' || g")):
    _at = {"substring": "TRUE", "prefix": "i = 1", "suffix": "i + n = length(word) + 1"}[_way]
    query(f"word_patterns_{_way}", f"WITH {_WORDS}, {_GRAMS} SELECT DISTINCT {_form} AS pattern FROM g WHERE n <= 4 AND {_at}")(lambda spark, d, w=_way: W.of_words(strings(spark, d), w, 4))


@query("word_record_counts", "SELECT word, count(*)::BIGINT AS card FROM (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(p_name, '\\S+')) AS word FROM part) GROUP BY 1")
def word_record_counts(spark, d):
    return W.word_counts(strings(spark, d))


@query("patterns_two_in_word", f"WITH {_WORDS}, {_GRAMS} SELECT '%' || g || '%' AS pattern FROM g WHERE n <= 5 UNION SELECT '%' || a.g || '%' || b.g || '%' FROM g a JOIN g b ON a.word = b.word AND b.i >= a.i + a.n AND a.n + b.n <= 4")
def patterns_two_in_word(spark, d):
    return W.two_in_word(strings(spark, d), 7)


@query("patterns_two_of_pair", f"WITH s AS (SELECT DISTINCT regexp_extract_all(p_name, '\\S+') AS ws FROM part), x AS (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM s), y AS (SELECT ws, i, unnest(range(i + 1, len(ws) + 1)) AS j FROM x), p AS (SELECT DISTINCT ws[i] AS a, ws[j] AS b FROM y), {_WORDS}, {_GRAMS} SELECT DISTINCT '%' || a.g || '%' || b.g || '%' AS pattern FROM p JOIN g a ON p.a = a.word JOIN g b ON p.b = b.word WHERE a.n + b.n <= 4")
def patterns_two_of_pair(spark, d):
    return W.two_of_pair(strings(spark, d), 7)


def _drawn(items: str, n: str, purpose: str, of: str) -> str:
    """n of a list's items by md5, in their own order."""
    h = f"list_transform({items}, lambda x, k: {{'h': left(md5('{purpose}-' || {of} || '-' || (k - 1)), 8), 'i': k, 'x': x}})"
    return f"list_transform(list_sort(list_transform(list_sort({h})[1:{n}], lambda t: {{'i': t.i, 'x': t.x}})), lambda t: t.x)"


@query("patterns_cut_words", f"WITH {_WORDS}, a AS (SELECT word, {_drawn('range(1, 4)', '1', 'head', chr(40) + chr(39) + chr(39) + ' || word || ' + chr(39) + '-1' + chr(39) + chr(41))}[1] AS i FROM w WHERE length(word) > 4), b AS (SELECT word, i, {_drawn('range(i, 4)', '1', 'tail', chr(40) + chr(39) + chr(39) + ' || word || ' + chr(39) + '-1' + chr(39) + chr(41))}[1] AS j FROM a) SELECT DISTINCT '%' || left(word, i) || '%' || right(word, 4 - j) || '%' AS pattern FROM b")
def patterns_cut_words(spark, d):
    return W.cut_long_words(strings(spark, d), 7)


@query("patterns_n_words", f"WITH s AS (SELECT DISTINCT p_name AS s FROM part), a AS (SELECT s, list_filter(regexp_extract_all(s, '\\S+'), lambda w: length(w) BETWEEN 2 AND 10) AS ws FROM s), b AS (SELECT s, ws, {_drawn('range(1, least(3, len(ws)) + 1)', '1', 'count', 's')}[1] AS n FROM a WHERE len(ws) > 0) SELECT DISTINCT '%' || array_to_string({_drawn('ws', 'n', 'words', 's')}, '%') || '%' AS pattern FROM b")
def patterns_n_words(spark, d):
    return W.n_words(strings(spark, d), 3)


@query("patterns_random_wildcards", "WITH s AS (SELECT DISTINCT p_name AS s FROM part WHERE p_name <> ''), a AS (SELECT s, string_split(s, '') AS c, left(md5('share-0-' || s), 8) AS share FROM s), b AS (SELECT s, c, list_transform(c, lambda x, i: left(md5('char-0-' || s || '-' || (i - 1)), 8) < share) AS hit FROM a), e AS (SELECT regexp_replace(array_to_string(list_transform(c, lambda x, i: CASE WHEN NOT hit[i] THEN x WHEN coalesce(i > 1 AND hit[i - 1], FALSE) OR coalesce(hit[i + 1], FALSE) THEN '%' ELSE '_' END), ''), '%+', '%', 'g') AS pattern FROM b) SELECT DISTINCT pattern FROM e WHERE pattern <> '%'")
def patterns_random_wildcards(spark, d):
    return W.random_wildcards(strings(spark, d))


@query("patterns_general", None)
def patterns_general(spark, d):
    """Drawn patterns with their counts (each at least 1)."""
    s = strings(spark, d)
    return C.typed(s, W.general(s))


@query("patterns_by_shape", None)
def patterns_by_shape(spark, d):
    shapes = spark.createDataFrame([("%w%", 2, 4), ("w%", 2, 5), ("%w", 1, 3), ("w%w", 2, 3), ("%w%w%", 2, 4), ("w%w%", 2, 3)], "shape string, low int, high int")
    return W.by_shape(strings(spark, d), shapes)


@query("patterns_without_test", f"WITH {_WORDS}, {_GRAMS}, x AS (SELECT DISTINCT '%' || g || '%' AS pattern FROM g WHERE n <= 4) SELECT pattern FROM x WHERE pattern NOT IN (SELECT '%' || substr(p_name, 1, 3) || '%' FROM part)")
def patterns_without_test(spark, d):
    return W.without(W.of_words(strings(spark, d), "substring", 4), patterns(spark, d, "substr"))


# --- reading language -------------------------------------------------------------------------------------------------

query("language_round_trip", f"WITH {_P} SELECT DISTINCT {_canon('pattern')} AS pattern, {_canon('pattern')} AS decoded FROM p WHERE pattern <> ''")(
    lambda spark, d: _forms(spark, d).select("pattern", L.decode(F.col("e.form"), F.col("e.ends")).alias("decoded"))
)


def _forms(spark, d):
    return patterns(spark, d).where("pattern <> ''").select(P.canonical(F.col("pattern")).alias("pattern")).distinct().withColumn("e", L.encode(F.col("pattern")))


@query("language_prefixes", None)
def language_prefixes(spark, d):
    """Patterns that the prefixes of all reading forms give, with the number of forms that share each."""
    return _forms(spark, d).select(F.explode(L.steps(F.col("pattern"))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


# --- text helpers -----------------------------------------------------------------------------------------------------


def _tail(q: str) -> str:
    t = f"regexp_extract({q}, '([%_]*)$', 1)"
    at = f"strpos(reverse({t}), '%')"
    return f"left({q}, length({q}) - length({t})) || CASE WHEN contains({t}, '%') THEN replace(left({t}, length({t}) - {at}), '%', '') || right({t}, {at}) ELSE {t} END"


_project("pattern_tail", "tail", X.normalised_tail, _tail("pattern"))
_project("aug_placeholder", "parts", lambda q: F.array_join(P.placeholder(q), "|"), f"array_to_string(list_transform(range(1, length(pattern) + 1), lambda i: {_tail('(left(pattern, i) || regexp_replace(substr(pattern, i + 1), chr(91) || chr(94) || chr(37) || chr(93), chr(95), chr(103)))')}), '|')")
_project("pattern_left_to_place", "n", lambda q: F.array_join(F.transform(X.left_to_place(q), lambda n: n.cast("string")), "|"), "array_to_string(list_transform(range(1, length(pattern) + 1), lambda i: length(replace(substr(pattern, i), '%', ''))::VARCHAR), '|')")
_project("pattern_chunks", "parts", lambda q: F.array_join(X.chunks(q, 3), "|"), "array_to_string(list_transform(range(1, length(pattern) + 1, 3), lambda i: substr(pattern, i, 3)), '|')")
_project("pattern_masked_signs", "masked", X.masked_signs, r"regexp_replace(pattern, '[!-/:-@\[-`{-~ ]', '_', 'g')")
_project("pattern_alphanumeric", "plain", X.alphanumeric, "regexp_replace(pattern, '[^A-Za-z0-9 ]+', '', 'g')")
_project("pattern_one_hot", "bits", lambda q: F.array_join(F.transform(X.one_hot(q, "%_aeiou", 4), lambda b: b.cast("string")), ""), "array_to_string(list_transform(range(0, 28), lambda k: (substr(pattern, k // 7 + 1, 1) = substr('%_aeiou', k % 7 + 1, 1))::INT::VARCHAR), '')")


@query("table_aliases", "SELECT DISTINCT event_type, array_to_string(list_transform(list_filter(string_split(event_type, '_'), lambda w: w <> ''), lambda w: left(w, 1)), '') AS alias FROM events")
def table_aliases(spark, d):
    return read(spark, d, "events").select("event_type", X.alias(F.col("event_type")).alias("alias")).distinct()


@query("edge_words", r"SELECT doc_id, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), (coalesce(text, '') <> '')::INT)::INT AS n FROM documents")
def edge_words(spark, d):
    """Words of all texts (null counts as empty); space at the edges belongs to them."""
    return read(spark, d, "documents").select("doc_id", F.size(X.edge_words(F.coalesce("text", F.lit("")))).alias("n"))


# --- plans and learned estimates ----------------------------------------------------------------------------------------


@query("plan_features", None)
def plan_features(spark, d):
    """Operators of a join query's physical plan."""
    df = views(spark, d).sql("SELECT n_name, count(*) AS n FROM customer c, nation n WHERE c_nationkey = n_nationkey AND (n_name LIKE '%A%' OR c_acctbal <> 1) AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY n_name")
    return features.rows(spark, features.plan(df))


@query("hybrid_estimates", None)
def hybrid_estimates(spark, d):
    """Learned from the patterns of the train split, applied to all; table hits are exact."""
    s, p, t = strings(spark, d), patterns(spark, d), S.ngram_table(strings(spark, d), GRAMS)
    bounds = S.upper_bound(t, p, GRAMS, 1)
    cards = C.naive(s, p)
    known = cards.join(S.shuffled_rank(p, "pattern").where(F.col("rank") < F.floor(F.col("total") * 0.8)).select("pattern"), "pattern")
    return H.estimate(H.fit(bounds, known), bounds, t, GRAMS).join(cards.withColumnRenamed("card", "true"), "pattern")


@query("qerror_by_length", _EST + ", t AS (SELECT pattern, coalesce(sum(w), 0) AS c FROM p LEFT JOIN s ON s LIKE pattern GROUP BY 1), q AS (SELECT pattern, greatest(greatest(c, 1)::DOUBLE / greatest(est, 1), greatest(est, 1)::DOUBLE / greatest(c, 1)) AS q FROM e JOIN t USING (pattern)) SELECT length(pattern)::INT AS len, length(regexp_replace(pattern, '[^%_]', '', 'g'))::INT AS n_wild, count(*)::BIGINT AS n, round(avg(q), 6) AS avg_q, round(max(q), 6) AS max_q FROM q GROUP BY 1, 2")
def qerror_by_length(spark, d):
    x = _estimates(spark, d).join(C.naive(strings(spark, d), patterns(spark, d)).withColumnRenamed("card", "true"), "pattern")
    y = H.q_errors_by(x, F.length("pattern").alias("len"), F.length(F.regexp_replace("pattern", "[^%_]", "")).alias("n_wild"))
    return y.select("len", "n_wild", "n", F.round("avg_q", 6).alias("avg_q"), F.round("max_q", 6).alias("max_q"))


@query("pattern_vectors", None)
def pattern_vectors(spark, d):
    return H.pattern_vectors(patterns(spark, d), H.token_vectors(token_sentences(spark, d)), "p_name_")


@query("substituted_selectivity", _EST + ", t AS (SELECT pattern, coalesce(sum(w), 0)::DOUBLE AS c FROM p LEFT JOIN s ON s LIKE pattern GROUP BY 1) SELECT t.pattern, CASE WHEN t.pattern LIKE '%bol%' THEN est ELSE c END AS used FROM t JOIN e ON t.pattern = e.pattern")
def substituted_selectivity(spark, d):
    """The model's estimate where it covers a pattern, the remainder's count elsewhere."""
    model = _estimates(spark, d).where(F.col("pattern").contains("bol")).select("pattern", "est")
    rest = C.naive(strings(spark, d), patterns(spark, d))
    return rest.join(model, "pattern", "left").select("pattern", F.coalesce("est", F.col("card").cast("double")).alias("used"))


def _records(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("rid"), F.col("p_name").alias("s"))


@query("lbs_estimates", None)
def lbs_estimates(spark, d):
    r = _records(spark, d)
    return lbs.estimate(patterns(spark, d), lbs.signatures(r, 3, _A, _B), r.count(), 3, len(_A))


@query("bound_longest_grams", f"{_NGRAM}, {_P}, {_bound_sql(least='least(' + str(GRAMS) + ', length(b))')} SELECT bd.pattern, bound, bound >= card AS ok FROM bd JOIN cd ON bd.pattern = cd.pattern")
def bound_longest_grams(spark, d):
    """Bounds from the longest sub-grams alone."""
    t, p = S.ngram_table(strings(spark, d), GRAMS), patterns(spark, d)
    x = S.upper_bound(t, p, GRAMS, 1, shorter=False).join(C.naive(strings(spark, d), p), "pattern")
    return x.select("pattern", "bound", (F.col("bound") >= F.col("card")).alias("ok"))


@query("char_fractions", f"WITH {_S}, n AS (SELECT sum(w) AS n FROM s), x AS (SELECT s, w, unnest(string_split(s, '')) AS ch FROM s), y AS (SELECT s, w, ch, count(*) AS k FROM x GROUP BY ALL) SELECT ch, round(sum(w) FILTER (left(s, 1) = ch) / any_value(n)::DOUBLE, 9) AS prefix, round(sum(w) / any_value(n)::DOUBLE, 9) AS substring, round(sum(w) FILTER (right(s, 1) = ch) / any_value(n)::DOUBLE, 9) AS suffix, round(sum(k * w) / any_value(n)::DOUBLE, 9) AS occurrence FROM y, n GROUP BY 1")
def char_fractions(spark, d):
    n = strings(spark, d).agg(F.sum("w").alias("n"))
    part = lambda c: F.round(F.nullif(F.col(c), F.lit(0)) / F.col("n").cast("double"), 9)
    return S.char_stats(strings(spark, d)).crossJoin(F.broadcast(n)).select("ch", part("n_pre").alias("prefix"), part("n_rec").alias("substring"), part("n_suf").alias("suffix"), part("n_occ").alias("occurrence"))


@query("token_list_sizes", f"WITH {_TOK}, s AS (SELECT DISTINCT p_name AS s FROM part), x AS (SELECT token, s, unnest(range(1, length(s) - length(token) + 2)) AS p FROM t, s) SELECT token, count(DISTINCT s)::BIGINT AS n_strings, count(*)::BIGINT AS n_positions, min(p)::INT AS first FROM x WHERE substr(s, p, length(token)) = token GROUP BY 1")
def token_list_sizes(spark, d):
    """Sizes of the position lists that an engine would join."""
    t = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    return C.postings(strings(spark, d), t).groupBy("token").agg(F.count("*").alias("n_strings"), F.sum(F.size("pos")).alias("n_positions"), F.min(F.array_min("pos")).alias("first"))


_POS = "WITH s AS (SELECT DISTINCT p_name AS s FROM part), x AS (SELECT s, unnest(range(1, length(s) + 1)) AS p FROM s), a AS (SELECT s, p FROM x WHERE substr(s, p, 1) = 'l'), b AS (SELECT s, p FROM x WHERE substr(s, p, 1) = 'e')"
for _name, _op in (("equal", "="), ("later", ">=")):
    query(f"position_join_back_{_name}", f"{_POS} SELECT a.s, count(DISTINCT a.p)::BIGINT AS n_left FROM a JOIN b ON a.s = b.s AND b.p - a.p {_op} 2 GROUP BY 1")(lambda spark, d, op=_op: _backward(spark, d, op))


def _backward(spark, d, op):
    """Positions of the left token that a fixed right side leaves."""
    s = strings(spark, d).select("s", P.occurrences(F.col("s"), F.lit("l")).alias("a"), P.occurrences(F.col("s"), F.lit("e")).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    left = F.array_intersect("a", F.transform("b", lambda p: p - 2)) if op == "=" else F.filter("a", lambda p: p <= F.array_max("b") - 2)
    return s.select("s", F.size(left).cast("long").alias("n_left")).where("n_left > 0")


@query("position_join_pairs", f"{_POS} SELECT a.s, a.p::INT AS lo, b.p::INT AS hi FROM a JOIN b ON a.s = b.s AND b.p - a.p BETWEEN 2 AND 5")
def position_join_pairs(spark, d):
    """Pairs of positions within a gap, as a bushy plan joins them: inside each string, without a join of rows."""
    s = strings(spark, d).select("s", P.occurrences(F.col("s"), F.lit("l")).alias("a"), P.occurrences(F.col("s"), F.lit("e")).alias("b"))
    return s.select("s", F.explode("a").alias("lo"), "b").select("s", "lo", F.explode(F.filter("b", lambda p: (p - F.col("lo")).between(2, 5))).alias("hi"))
