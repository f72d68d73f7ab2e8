"""Registered queries over real texts (words of documents, addresses of pages), and of predicates, workload pieces and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import words as X
from .operators import counting as C
from .operators import engines as N
from .operators import predicates as K
from .operators import reports as R
from .operators import statistics as S
from .operators import workloads as W

from .queries import _A, _B, _BOUND, _P, _S, GRAMS, SQL, _canon, _card_sql, _project, patterns, query, read, strings, views
from .sources import files


# --- engines on the same patterns ---------------------------------------------------------------------------------------


for _name, _engine in {"narrow": N.narrow, "ordered": N.ordered, "forward": lambda s, p: N.ordered(s, p, "forward"), "backward": lambda s, p: N.ordered(s, p, "backward"), "digits": lambda s, p: N.ordered(s, p, "102")}.items():
    query(f"like_card_{_name}", _card_sql(None))(lambda spark, d, e=_engine: e(strings(spark, d), patterns(spark, d)))


@query("both_aug_cards", f"WITH {_P}, {_S}, c AS (SELECT DISTINCT {_canon('pattern')} AS q FROM p), x AS (SELECT q, unnest(range(1, length(q) + 1)) AS n FROM c), y AS (SELECT left(q, n) AS pattern FROM x UNION SELECT right(q, n) FROM x) SELECT pattern, coalesce(sum(w), 0)::BIGINT AS card FROM y LEFT JOIN s ON s LIKE pattern GROUP BY 1")
def both_aug_cards(spark, d):
    return C.both_cards(strings(spark, d), patterns(spark, d))


# --- words of all documents ---------------------------------------------------------------------------------------------

_GAP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_DOC = f"s AS (SELECT word AS s, count(*) AS w FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM documents) GROUP BY 1)"
#: Patterns of the words of the benchmark's items and of the conversations' first turns, and some with wildcards alone.
_ASKED = f"""x AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations WHERE turn = 0)),
  y AS (SELECT word FROM x WHERE length(word) BETWEEN 4 AND 12 AND NOT regexp_matches(word, '[%_\\\\]')),
  p AS (SELECT '%' || substr(word, 2, 3) || '%' AS pattern FROM y UNION SELECT left(word, 3) || '%' FROM y UNION SELECT '%' || right(word, 3) FROM y UNION SELECT word FROM y
    UNION SELECT left(word, 2) || '_%' || right(word, 1) FROM y UNION SELECT '%' || left(word, 2) || '%' || right(word, 2) || '%' FROM y UNION SELECT column0 FROM (VALUES ('%'), ('____'), ('___%'), ('_______________%'), ('%zzzz%')) AS v(column0))"""


def doc_words(spark, d):
    """All words of all documents with how often they occur."""
    w = read(spark, d, "documents").select(F.explode(F.split("text", _GAP)).alias("s")).where("s <> ''")
    return w.groupBy("s").agg(F.count("*").alias("w"))


def asked(spark, d):
    t = read(spark, d, "benchmark").select("text").unionAll(read(spark, d, "conversations").where("turn = 0").select("text"))
    y = t.select(F.explode(F.split("text", _GAP)).alias("word")).distinct().where(F.length("word").between(4, 12) & ~F.col("word").rlike(r"[%_\\]"))
    w, p = F.col("word"), F.lit("%")
    forms = [F.concat(p, F.substr(w, F.lit(2), F.lit(3)), p), F.concat(F.left(w, F.lit(3)), p), F.concat(p, F.right(w, F.lit(3))), w]
    forms += [F.concat(F.left(w, F.lit(2)), F.lit("_%"), F.right(w, F.lit(1))), F.concat(p, F.left(w, F.lit(2)), p, F.right(w, F.lit(2)), p)]
    fixed = spark.createDataFrame([(q,) for q in ("%", "____", "___%", "_______________%", "%zzzz%")], "pattern string")
    return y.select(F.explode(F.array(*forms)).alias("pattern")).unionAll(fixed).distinct()

_WORD_CARDS = f"WITH {_DOC}, {_ASKED} SELECT pattern, coalesce(sum(w), 0)::BIGINT AS card FROM p LEFT JOIN s ON s LIKE pattern GROUP BY 1"
for _name, _engine in {"naive": C.naive, "candidates": C.candidates, "typed": C.typed, "positional": C.positional, "narrow": N.narrow, "ordered": N.ordered, "by_parts": C.by_parts}.items():
    query(f"word_cards_{_name}", _WORD_CARDS)(lambda spark, d, e=_engine: e(doc_words(spark, d), asked(spark, d)))

for _way, _part in (("prefix", "left(s, n)"), ("suffix", "right(s, n)")):
    query(f"doc_{_way}_counts", f"WITH {_DOC} SELECT {_part} AS part, sum(w)::BIGINT AS card FROM (SELECT s, w, unnest(range(1, least(8, length(s)) + 1)) AS n FROM s WHERE NOT regexp_matches(s, '[%_]')) GROUP BY 1")(lambda spark, d, w=_way: S.summary(doc_words(spark, d), w))


@query("doc_gram_counts", f"WITH {_DOC}, g AS (SELECT DISTINCT s, w, substr(s, i, 3) AS gram FROM (SELECT s, w, unnest(range(1, length(s) - 1)) AS i FROM s)) SELECT gram, sum(w)::BIGINT AS cnt FROM g GROUP BY 1")
def doc_gram_counts(spark, d):
    """Three-character grams of all words: how many word occurrences hold each."""
    return doc_words(spark, d).select("w", F.explode(C.grams(F.col("s"))).alias("gram")).groupBy("gram").agg(F.sum("w").alias("cnt"))


@query("doc_char_stats", SQL["char_stats"].replace(_S, _DOC))
def doc_char_stats(spark, d):
    return S.char_stats(doc_words(spark, d))


# --- addresses of all pages -----------------------------------------------------------------------------------------------

_URL = "s AS (SELECT coalesce(url, '') AS s, count(*) AS w FROM pages GROUP BY 1)"
_PARTS = "p AS (SELECT DISTINCT left(s, strpos(substr(s, 9), '/') + 8) || '%' AS pattern FROM s WHERE length(s) > 12 UNION SELECT '%' || right(s, 4) FROM s WHERE length(s) > 12 UNION SELECT '%' || substr(s, 9, 4) || '%' || right(s, 2) FROM s WHERE length(s) > 12)"


def urls(spark, d):
    return C.weighted(read(spark, d, "pages"), "url")


def url_patterns(spark, d):
    s, p = F.col("s"), F.lit("%")
    x = urls(spark, d).where(F.length("s") > 12)
    host = F.left(s, F.locate("/", F.substr(s, F.lit(9))) + 8)
    return x.select(F.explode(F.array(F.concat(host, p), F.concat(p, F.right(s, F.lit(4))), F.concat(p, F.substr(s, F.lit(9), F.lit(4)), p, F.right(s, F.lit(2))))).alias("pattern")).distinct()

_URL_CARDS = f"WITH {_URL}, {_PARTS} SELECT pattern, coalesce(sum(w), 0)::BIGINT AS card FROM p LEFT JOIN s ON s LIKE replace(pattern, '\\', '\\\\') ESCAPE '\\' GROUP BY 1"
for _name, _engine in {"naive": C.naive, "typed": C.typed, "narrow": N.narrow}.items():
    query(f"url_cards_{_name}", _URL_CARDS)(lambda spark, d, e=_engine: e(urls(spark, d), url_patterns(spark, d)))


@query("url_signatures", "WITH x AS (SELECT DISTINCT page_id AS rid, substr(url, i, n) AS gram FROM (SELECT page_id, url, i, unnest(range(1, least(3, length(url) - i + 1) + 1)) AS n FROM (SELECT page_id, url, unnest(range(1, length(url) + 1)) AS i FROM pages))) SELECT gram, count(*)::BIGINT AS cnt, " + ", ".join(f"min((rid * {a} + {b}) % 2147483647)::BIGINT AS h{i + 1}" for i, (a, b) in enumerate(zip(_A, _B, strict=True))) + " FROM x GROUP BY 1")
def url_signatures(spark, d):
    r = read(spark, d, "pages").select(F.col("page_id").cast("long").alias("rid"), F.col("url").alias("s"))
    return S.minhash_signatures(r, 3, _A, _B).select("gram", "cnt", *[F.col(f"h{i + 1}").cast("long").alias(f"h{i + 1}") for i in range(len(_A))])


# --- pattern functions ----------------------------------------------------------------------------------------------------

_project("aug_delimiter_unique", "parts", lambda q: F.array_join(P.delimiter(q, True), "|"), "array_to_string(list_transform(list_filter(range(1, length(pattern) + 1), lambda i: right(left(pattern, i), 1) <> '%' OR left(pattern, i) = '%'), lambda i: left(pattern, i) || CASE WHEN right(left(pattern, i), 1) = '%' THEN '' ELSE '%' END), '|')")
_project("aug_delimiter_trim", "parts", lambda q: F.array_join(P.delimiter(q, False, True), "|"), "array_to_string(list_transform(range(1, length(pattern)), lambda i: left(pattern, i) || CASE WHEN right(left(pattern, i), 1) = '%' THEN '' ELSE '%' END), '|')")
_project("wildcard_runs", "runs", lambda q: F.array_join(P.wildcard_runs(q), "|"), "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(pattern, '[%_]+'), lambda r: true))), '|')")
_project("char_codes", "codes", lambda q: F.array_join(F.transform(X.hashed(q, 97, 8), lambda c: c.cast("string")), ","), "array_to_string(list_transform(range(1, 9), lambda i: CASE WHEN i > length(pattern) THEN 0 ELSE unicode(substr(pattern, i, 1)) % 97 + 1 END), ',')")


@query("aug_all", None)
def aug_all(spark, d):
    """All augmentations of all patterns, each once."""
    return patterns(spark, d).select(F.explode(P.augmented(F.col("pattern"))).alias("pattern")).distinct()


@query("wildcard_alphabet", f"WITH {_P} SELECT DISTINCT unnest(regexp_extract_all(pattern, '[%_]+')) AS run FROM p")
def wildcard_alphabet(spark, d):
    return patterns(spark, d).select(F.explode(P.wildcard_runs(F.col("pattern"))).alias("run")).distinct()


@query("wildcard_order", f"WITH {_P}, c AS (SELECT DISTINCT {_canon('pattern')} AS q FROM p), k AS (SELECT q, list_transform(string_split(q, ''), lambda x: CASE x WHEN '%' THEN -2 WHEN '_' THEN -1 WHEN '' THEN -3 ELSE 1114112 - unicode(x) END) AS key FROM c), o AS (SELECT q, row_number() OVER (ORDER BY key) - 1 AS nth FROM k) SELECT q AS pattern, nth::BIGINT AS nth, EXISTS (SELECT 1 FROM c WHERE NOT regexp_matches(o.q, '[%_]$') AND o.q <> '' AND starts_with(c.q, o.q) AND substr(c.q, length(o.q) + 1, 1) IN ('%', '_')) AS shares FROM o")
def wildcard_order(spark, d):
    """Places in the wildcard-aware order, and whether the next pattern goes on from this one."""
    return R.shared_starts(patterns(spark, d))


@query("pattern_conditions", None)
def pattern_conditions(spark, d):
    """The conditions that each pattern puts on places: kind, least distance, whether it may be greater."""
    q = patterns(spark, d).select("pattern", P.canonical(F.col("pattern")).alias("q"))
    q = q.select("pattern", P.tokens(F.col("q")).alias("t"), P.ops(F.col("q")).alias("o")).where(F.size("t") > 0)
    under = lambda o: F.length(F.replace(o, F.lit("%"), F.lit("")))
    m = F.size("t")
    one = lambda i, o: F.struct(F.when(i == 0, "prefix").when(i == m, "suffix").otherwise("substring").alias("kind"), (under(o) + F.when(i == 0, 1).when(i == m, F.length(F.get("t", i - 1)) - 1).otherwise(F.length(F.get("t", i - 1)))).alias("number"), F.contains(o, F.lit("%")).alias("open"))
    return q.select("pattern", F.posexplode(F.transform("o", lambda o, i: one(i, o))).alias("i", "c")).select("pattern", "i", "c.*")


# --- predicates -----------------------------------------------------------------------------------------------------------

_TESTS = [("p_name", "LIKE", "%bolt%"), ("p_name", "NOT LIKE", "red%"), ("p_size", ">=", 25), ("p_size", "!=", 7), ("p_size", "<", 10), ("p_retailprice", ">", 1500.5), ("p_brand", "=", "Brand#12"), ("p_brand", "IN", ["Brand#13", "Brand#21"]), ("p_name", "IS NULL", None), ("p_name", "IS NOT NULL", None)]


def _told(c: str, op: str, v) -> str:
    lit = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"{c} {op}" if v is None else f"{c} IN ({', '.join(map(lit, v))})" if op == "IN" else f"{c} {op} {lit(v)}"


@query("predicate_matrix", "SELECT p_partkey, " + ", ".join(f"coalesce({_told(*t)}, false) AS t{i}" for i, t in enumerate(_TESTS)) + f", (coalesce({_told(*_TESTS[0])}, false) AND (coalesce({_told(*_TESTS[2])}, false) OR NOT coalesce({_told(*_TESTS[3])}, false))) AS tree FROM part")
def predicate_matrix(spark, d):
    x = read(spark, d, "part")
    node = ("AND", [_TESTS[0], ("OR", [_TESTS[2], ("NOT", _TESTS[3])])])
    return x.select("p_partkey", *[K.test(x, *t).alias(f"t{i}") for i, t in enumerate(_TESTS)], K.tree(x, node).alias("tree"))


@query("bitmap_like", "SELECT event_type, count(*) FILTER (event_type LIKE 'a\\_%' ESCAPE '\\')::BIGINT AS n_a, count(*) FILTER (event_type LIKE '%\\_%' ESCAPE '\\')::BIGINT AS n_under, count(*) FILTER (event_type LIKE '%c%')::BIGINT AS n_c FROM events GROUP BY 1")
def bitmap_like(spark, d):
    """LIKE as bitmaps read it: `_` stands for itself."""
    c = F.col("event_type")
    n = lambda q: F.count_if(K.like_plain_underscore(c, F.lit(q)))
    return read(spark, d, "events").groupBy("event_type").agg(n("a_%").alias("n_a"), n("%_%").alias("n_under"), n("%c%").alias("n_c"))


@query("utf8_repair", "WITH x AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, NOT (length(h) > 200 AND substr(h, 201, 1) IN ('8', '9', 'A', 'B')) AS valid FROM x")
def utf8_repair(spark, d):
    """Whether the first 100 bytes of a text are UTF-8, that is, don't end inside a character; readable() repairs them (see the tests)."""
    x = read(spark, d, "documents").where("text is not null").select("doc_id", F.substring(F.col("text").cast("binary"), 1, 100).alias("cut"))
    return x.select("doc_id", files.valid_utf8("cut").alias("valid"))


# --- workload pieces --------------------------------------------------------------------------------------------------------

_PIECE = "w AS (SELECT DISTINCT unnest(regexp_extract_all(p_name, '\\S+')) AS word FROM part), g AS (SELECT word, i, n, substr(word, i, n) AS g FROM (SELECT word, i, unnest(range(1, length(word) - i + 2)) AS n FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)))"
_KINDS = "k AS (SELECT DISTINCT 'SUBSTR' AS kind, 1 AS n, '%' || g || '%' AS pattern FROM g WHERE n <= 4 UNION SELECT 'PREFIX', 1, g || '%' FROM g WHERE n <= 4 AND i = 1 UNION SELECT 'SUFFIX', 1, '%' || g FROM g WHERE n <= 4 AND i + n = length(word) + 1)"


def _kinds(spark, d):
    s, out = strings(spark, d), None
    for kind, way in (("SUBSTR", "substring"), ("PREFIX", "prefix"), ("SUFFIX", "suffix")):
        x = W.of_words(s, way, 4).select(F.lit(kind).alias("kind"), F.lit(1).alias("n"), "pattern")
        out = x if out is None else out.unionAll(x)
    return out


@query("workload_uniform", f"WITH {_PIECE}, {_KINDS}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, n ORDER BY md5('0-' || pattern), pattern) - 1 AS r, count(*) OVER (PARTITION BY kind, n) AS c FROM k), t AS (SELECT *, CASE WHEN c >= 60 THEN 5 ELSE floor(5 * c / 60.0) END AS a, CASE WHEN c >= 60 THEN 50 ELSE floor(50 * c / 60.0) END AS b FROM r) SELECT kind, n, pattern, CASE WHEN r < a THEN 'test' WHEN r < 2 * a THEN 'valid' ELSE 'train' END AS split FROM t WHERE r < 2 * a + b")
def workload_uniform(spark, d):
    """As many patterns of each kind, for a column of fewer than 500 different strings."""
    return W.uniform(_kinds(spark, d), 100)


@query("workload_drawn", None)
def workload_drawn(spark, d):
    """A uniform workload of drawn patterns of one and two tokens."""
    s = strings(spark, d)
    return W.uniform(W.general_kinds(s), s.count())


@query("workload_two_tokens", f"WITH {_P}, t AS (SELECT DISTINCT concat('%', substr(p_name, 1, 3), '%') AS pattern FROM part) SELECT pattern FROM p WHERE len(regexp_extract_all(pattern, '[^%_]+')) = 2 AND pattern NOT IN (SELECT pattern FROM t)")
def workload_two_tokens(spark, d):
    return W.with_tokens(patterns(spark, d), 2, patterns(spark, d, "substr"))


@query("workload_clipped", f"WITH {_P}, r AS (SELECT pattern, row_number() OVER (PARTITION BY length(pattern) ORDER BY md5('0-' || pattern), pattern) - 1 AS r, count(*) OVER (PARTITION BY length(pattern)) AS n FROM p) SELECT pattern FROM r WHERE r < floor(greatest(0.3, 1.0 / n) * n + 1e-9)")
def workload_clipped(spark, d):
    return W.clipped(patterns(spark, d), "pattern", 0.3)

_BARE = "list_filter(regexp_split_to_array(regexp_replace(pattern, '^%+|%+$', '', 'g'), '%+'), lambda x: x <> '')"


@query("workload_steps", f"WITH {_P}, x AS (SELECT pattern, {_BARE} AS ps FROM p) SELECT CASE WHEN len(ps) <= 1 THEN pattern ELSE '%' || ps[1] || '%' END AS pattern, 1 AS step FROM x UNION SELECT pattern, 2 FROM x WHERE len(ps) > 1")
def workload_steps(spark, d):
    return W.in_steps(patterns(spark, d))


@query("workload_union", f"WITH {_PIECE}, {_S}, k AS (SELECT 'substring' AS kind, '%' || g || '%' AS pattern FROM g WHERE n <= 4 UNION SELECT 'prefix', g || '%' FROM g WHERE n <= 4 AND i = 1 UNION SELECT 'suffix', '%' || g FROM g WHERE n <= 4 AND i + n = length(word) + 1) SELECT kind, pattern, coalesce(sum(w), 0)::BIGINT AS card FROM k LEFT JOIN s ON s LIKE pattern GROUP BY 1, 2")
def workload_union(spark, d):
    return W.split_union(strings(spark, d))

_CARDS = "t AS (SELECT pattern, coalesce(sum(w), 0)::BIGINT AS card FROM p LEFT JOIN s ON s LIKE pattern GROUP BY 1)"


@query("workload_valid", f"WITH {_P}, {_S}, {_CARDS} SELECT pattern, card FROM t WHERE card > 0 ORDER BY md5('0-' || pattern), pattern LIMIT 50")
def workload_valid(spark, d):
    return W.valid_instances(C.naive(strings(spark, d), patterns(spark, d)), 50)


@query("typed_parts", f"WITH {_P}, x AS (SELECT pattern, {_canon('pattern', True)} AS q FROM p), y AS (SELECT pattern, NOT starts_with(q, '%') AND ends_with(q, '%') AS l, starts_with(q, '%') AND NOT ends_with(q, '%') AS r, list_filter(regexp_split_to_array(q, '%+'), lambda x: x <> '') AS ps FROM x), z AS (SELECT pattern, l, r, len(ps) AS k, unnest(ps) AS part, unnest(range(0, len(ps))) AS i FROM y) SELECT pattern, i::INT AS i, part, CASE WHEN l AND i = 0 THEN 'prefix' WHEN r AND i = k - 1 THEN 'suffix' ELSE 'substring' END AS kind FROM z")
def typed_parts(spark, d):
    return R.typed_parts(patterns(spark, d))


@query("readable_patterns", f"WITH {_P}, {_S}, v AS (SELECT DISTINCT unnest(string_split(s, '')) AS ch FROM s), x AS (SELECT pattern, unnest(string_split(pattern, '')) AS ch FROM p), o AS (SELECT DISTINCT pattern FROM x WHERE ch NOT IN ('', '%', '_') AND ch NOT IN (SELECT ch FROM v)) SELECT pattern FROM p WHERE pattern NOT IN (SELECT pattern FROM o)")
def readable_patterns(spark, d):
    """Patterns whose characters a model of this column knows."""
    return R.readable_only(patterns(spark, d), S.char_stats(strings(spark, d)))


@query("packed_loss", f"{SQL['bound_prefixes'].rpartition(' SELECT whole AS pattern')[0]}, l AS (SELECT bound, in_table, (SELECT coalesce(sum(w), 0) FROM s WHERE s LIKE prefix) AS c FROM pz JOIN bd ON prefix = bd.pattern JOIN it ON prefix = it.pattern) SELECT count(*)::BIGINT AS n, round(avg(pow(ln(1 + greatest(bound, 1e-7)) - ln(1 + greatest(c, 1e-7)), 2)), 6) AS loss FROM l WHERE NOT in_table")
def packed_loss(spark, d):
    """The loss of the bounds over all prefixes that the n-gram table doesn't answer."""
    from .queries import bound_prefixes

    x = bound_prefixes(spark, d)
    cards = C.typed(strings(spark, d), x.select(F.col("prefix").alias("pattern"))).select(F.col("pattern").alias("prefix"), F.col("card").alias("true"))
    x = x.join(cards, "prefix").select("prefix_len", F.lit(1 << 30).alias("len"), "in_table", "true", F.col("bound").alias("est"))
    return R.packed_loss(x).withColumn("loss", F.round("loss", 6))


# --- reports ----------------------------------------------------------------------------------------------------------------


@query("hash_ranks", "SELECT s_suppkey::BIGINT AS rid, (row_number() OVER (ORDER BY (s_suppkey * 48271 + 11) % 2147483647, s_suppkey) - 1)::BIGINT AS rank FROM supplier")
def hash_ranks(spark, d):
    return R.hash_ranks(read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("rid")), _A[0], _B[0])


@query("log_unscaled_cards", f"WITH {_P}, {_S}, {_CARDS} SELECT pattern, greatest(card, 1)::BIGINT AS back FROM t")
def log_unscaled_cards(spark, d):
    """Scaled logarithms taken back give the counts again (at least 1)."""
    x = C.naive(strings(spark, d), patterns(spark, d))
    low, high = x.agg(F.ln(F.greatest(F.min("card"), F.lit(1)).cast("double")), F.ln(F.greatest(F.max("card"), F.lit(1)).cast("double"))).first()
    return R.log_scaled(x, "card").select("pattern", F.round(R.unscaled(F.col("scaled"), low, high)).cast("long").alias("back"))


@query("subplan_log_range", "WITH x AS (" + SQL["subplan_counts"] + ") SELECT count(*)::BIGINT AS n, min(length(subplan))::INT AS least_relations, max(length(subplan))::INT AS most_relations, round(min(ln(greatest(card, 1)::DOUBLE)), 9) AS low, round(max(ln(greatest(card, 1)::DOUBLE)), 9) AS high FROM x")
def subplan_log_range(spark, d):
    """Ends of the logarithms of all sub-plans' counts, and the plans' sizes."""
    from .queries import subplan_counts

    v = F.ln(F.greatest(F.col("card").cast("double"), F.lit(1.0)))
    return subplan_counts(spark, d).agg(F.count("*").alias("n"), F.min(F.length("subplan")).alias("least_relations"), F.max(F.length("subplan")).alias("most_relations"), F.round(F.min(v), 9).alias("low"), F.round(F.max(v), 9).alias("high"))


@query("column_tokens", "WITH x AS (SELECT 'p_name_' || unnest(regexp_extract_all(p_name, '[^ ]+')) AS token FROM part UNION ALL SELECT 'p_brand_' || p_brand FROM part UNION ALL SELECT 'p_type_' || unnest(regexp_extract_all(p_type, '[^ ]+')) FROM part) SELECT token, count(*)::BIGINT AS n FROM x WHERE token IS NOT NULL GROUP BY 1")
def column_tokens(spark, d):
    """Token dictionary of several columns, each with its column's prefix."""
    x = read(spark, d, "part")
    words = lambda c: F.transform(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda t: t != ""), lambda t: F.concat(F.lit(f"{c}_"), t))
    brand = F.when(F.col("p_brand").isNotNull(), F.array(F.concat(F.lit("p_brand_"), F.col("p_brand")))).otherwise(F.array().cast("array<string>"))
    return x.select(F.explode(F.concat(words("p_name"), brand, words("p_type"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# --- estimators by name ---------------------------------------------------------------------------------------------------


def _estimated(spark, d, name):
    """Learned from the train split's labels, estimated for all patterns, beside the counts."""
    from .registry import estimator

    s, p = strings(spark, d), patterns(spark, d)
    cards = C.naive(s, p)
    known = S.shuffled_rank(p, "pattern").where(F.col("rank") < F.floor(F.col("total") * 0.8)).select("pattern")
    model = estimator(name).fit(s, cards.join(known, "pattern"))
    return model.estimate(p).join(cards.withColumnRenamed("card", "true"), "pattern")


for _name in ("recurrent", "attention", "chained", "corrected", "embedded", "bits"):
    query(f"estimates_{_name}", None)(lambda spark, d, n=_name: _estimated(spark, d, n))
query("estimates_bound", f"{_BOUND}, h AS (SELECT pattern, regexp_replace(regexp_replace({_canon('pattern', True)}, '^%+', ''), '%+$', '') AS core FROM p) SELECT bd.pattern, CASE WHEN length(core) BETWEEN 1 AND {GRAMS} AND NOT contains(core, '%') AND card > 0 THEN card ELSE bound END::DOUBLE AS est, card AS true FROM bd JOIN cd ON bd.pattern = cd.pattern JOIN h ON h.pattern = bd.pattern")(lambda spark, d: _estimated(spark, d, "bound"))
