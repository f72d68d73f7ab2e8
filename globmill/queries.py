"""Registered queries and their SQL for DuckDB, for the operators on strings, patterns and joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import patterns as P
from .operators import counting as C
from .operators import estimators as E
from .operators import reports as R
from .operators import statistics as S
from .plans import planner, sqltext
from .streaming import grams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "benchmark", "conversations")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def views(spark: SparkSession, d: str) -> SparkSession:
    for t in TABLES:
        read(spark, d, t).createOrReplaceTempView(t)
    return spark


# --- pattern sets, derived from the data ---------------------------------------------------------------------------

_FORMS = {
    "substr": "concat('%', substr(p_name, 1, 3), '%')",
    "prefix": "concat(substr(p_name, 1, 5), '%')",
    "suffix": "concat('%', substr(p_name, length(p_name) - 3, 4))",
    "exact": "p_name",
    "general": "concat(substr(p_name, 1, 2), '_%', substr(p_name, 5, 2), '__%%', substr(p_name, length(p_name), 1))",
    "multi": "concat('%', substr(p_name, 2, 2), '%', substr(p_name, length(p_name) - 2, 2), '%')",
}
#: Shapes that data doesn't give: wildcards alone, no match, signs that are special elsewhere, edges.
_FIXED = ["%", "_", "%__", "____%", "", "%zzz%", "%a.b%", "%(x)%", "%[1]%", "_e%", "%bol_", "a%%b", "%__%", "_%_%d%", "%é%"]
_VALUES = ", ".join(f"('{p}')" for p in _FIXED)


def _patterns_sql(kind: str | None = None) -> str:
    """Distinct patterns: text that both engines read alike."""
    forms = [kind] if kind else list(_FORMS)
    parts = " UNION ALL ".join(f"SELECT {_FORMS[k]} AS pattern FROM part" for k in forms)
    return f"SELECT DISTINCT pattern FROM ({parts}" + ("" if kind else f" UNION ALL SELECT column0 AS pattern FROM (VALUES {_VALUES}) AS v(column0)") + ") AS x"


def patterns(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    return views(spark, d).sql(_patterns_sql(kind))


def strings(spark: SparkSession, d: str) -> DataFrame:
    return C.weighted(read(spark, d, "part"), "p_name")


_P = f"p AS ({_patterns_sql()})"
_S = "s AS (SELECT p_name AS s, count(*) AS w FROM part GROUP BY 1)"


def _card_sql(kind: str | None) -> str:
    return f"WITH p AS ({_patterns_sql(kind)}), {_S} SELECT pattern, coalesce(sum(w), 0)::BIGINT AS card FROM p LEFT JOIN s ON s LIKE pattern GROUP BY pattern"


for _kind in _FORMS:
    query(f"like_card_{_kind}", _card_sql(_kind))(lambda spark, d, k=_kind: C.naive(strings(spark, d), patterns(spark, d, k)))
for _name, _engine in (("naive", C.naive), ("candidates", C.candidates), ("typed", C.typed), ("positional", C.positional), ("planned", planner.count)):
    query(f"like_card_{_name}", _card_sql(None))(lambda spark, d, e=_engine: e(strings(spark, d), patterns(spark, d)))

_CUSTOMER = "SELECT DISTINCT concat('%', substr(c_name, length(c_name) - 2, 3)) AS pattern FROM customer UNION SELECT DISTINCT concat(substr(c_name, 1, length(c_name) - 2), '%') FROM customer"


@query("like_card_customers", f"WITH p AS ({_CUSTOMER}) SELECT pattern, count(c_name)::BIGINT AS card FROM p LEFT JOIN customer ON c_name LIKE pattern GROUP BY 1")
def like_card_customers(spark, d):
    return C.typed(C.weighted(read(spark, d, "customer"), "c_name"), views(spark, d).sql(_CUSTOMER))


_CANON = r"""array_to_string(list_transform(regexp_extract_all({q}, '[%_]+|[^%_]+'), lambda r: CASE WHEN r[1] IN ('%', '_') AND contains(r, '%') THEN '%' || replace(r, '%', '') ELSE r END), '')"""


def _canon(q: str, flip: bool = False) -> str:
    c = _CANON.format(q=q)
    if not flip:
        return c
    tail = f"regexp_extract({c}, '([%_]*)$', 1)"
    return f"left({c}, length({c}) - length({tail})) || CASE WHEN contains({tail}, '%') THEN replace({tail}, '%', '') || '%' ELSE {tail} END"


@query("prefix_aug_cards", f"WITH {_P}, {_S}, c AS (SELECT pattern, {_canon('pattern')} AS q FROM p), x AS (SELECT pattern, unnest(range(1, length(q) + 1)) AS n, q FROM c) SELECT pattern, n::INT AS prefix_len, coalesce((SELECT sum(w) FROM s WHERE s LIKE left(q, n)), 0)::BIGINT AS card FROM x")
def prefix_aug_cards(spark, d):
    return C.prefix_cards(strings(spark, d), patterns(spark, d))


@query("suffix_aug_cards", f"WITH {_P}, {_S}, c AS (SELECT DISTINCT {_canon('pattern')} AS q FROM p), x AS (SELECT q, unnest(range(1, length(q) + 1)) AS n FROM c) SELECT q AS pattern, n::INT AS suffix_len, coalesce((SELECT sum(w) FROM s WHERE s LIKE right(q, n)), 0)::BIGINT AS card FROM x")
def suffix_aug_cards(spark, d):
    return C.suffix_cards(strings(spark, d), patterns(spark, d))


# --- pattern functions ---------------------------------------------------------------------------------------------


def _project(name: str, column: str, make, sql: str) -> None:
    query(name, f"WITH {_P} SELECT pattern, {sql} AS {column} FROM p")(lambda spark, d: patterns(spark, d).select("pattern", make(F.col("pattern")).alias(column)))


_RUNS = "regexp_extract_all(pattern, '[%_]+|[^%_]+')"
_project("pattern_parse", "runs", lambda q: F.array_join(P.runs(q), "|"), f"array_to_string({_RUNS}, '|')")
_project("pattern_canonical", "canonical", P.canonical, _canon("pattern"))
_project("pattern_flipped", "flipped", lambda q: P.canonical(q, True), _canon("pattern", True))
_project("pattern_type", "kind", P.kind, "CASE WHEN pattern LIKE '\\%%' ESCAPE '\\' AND pattern LIKE '%\\%' ESCAPE '\\' THEN 'SUBSTR' WHEN pattern LIKE '%\\%' ESCAPE '\\' THEN 'PREFIX' WHEN pattern LIKE '\\%%' ESCAPE '\\' THEN 'SUFFIX' ELSE 'EXACT' END")
_project("pattern_shape", "shape", P.shape, "regexp_replace(pattern, '[^%_]+', 'w', 'g')")
_project("pattern_num_tokens", "n_tokens", lambda q: F.size(P.tokens(q)), "len(regexp_extract_all(pattern, '[^%_]+'))::INT")
_project("pattern_interior_ops", "ops", lambda q: F.array_join(P.interior_ops(q), "|"), "array_to_string(list_filter(regexp_extract_all(regexp_replace(regexp_replace(pattern, '^[%_]+', ''), '[%_]+$', ''), '[%_]+'), lambda x: true), '|')")
_project("aug_delimiter", "parts", lambda q: F.array_join(P.delimiter(q), "|"), "array_to_string(list_transform(range(1, length(pattern) + 1), lambda i: rtrim(left(pattern, i), '') || CASE WHEN right(left(pattern, i), 1) = '%' THEN '' ELSE '%' END), '|')")
_project("aug_prefix", "parts", lambda q: F.array_join(P.prefixes(q), "|"), "array_to_string(list_transform(range(1, length(pattern) + 1), lambda i: left(pattern, i)), '|')")

for _mode, _flip in (("simple", True), ("normal", False)):
    for _way in ("forward", "backward", "both"):
        _sides = {"forward": "left(q, i)", "backward": "right(q, i)"}
        _lists = [f"list_transform(range(1, length(q) + 1), lambda i: {_sides[w]})" for w in (["forward", "backward"] if _way == "both" else [_way])]
        query(
            f"packed_{_mode}_{_way}",
            f"WITH {_P}, c AS (SELECT pattern, {_canon('pattern', _flip)} AS q FROM p), x AS (SELECT pattern, unnest({' || '.join(_lists)}) AS t FROM c) SELECT DISTINCT pattern, {_canon('t')} AS sub FROM x",
        )(lambda spark, d, m=_mode, w=_way: patterns(spark, d).select("pattern", F.explode(P.packed(F.col("pattern"), m, w)).alias("sub")))


@query("packed_core", f"WITH {_P}, c AS (SELECT pattern, regexp_replace(regexp_replace(pattern, '^%+', ''), '%+$', '') AS q FROM p), x AS (SELECT pattern, regexp_replace(regexp_replace(unnest(list_transform(range(1, length(q) + 1), lambda i: left(q, i))), '^%+', ''), '%+$', '') AS t FROM c), y AS (SELECT pattern, unnest(['%' || t || '%', t || '%', '%' || t]) AS t FROM x WHERE t <> '') SELECT DISTINCT pattern, {_canon('t')} AS sub FROM y")
def packed_core(spark, d):
    return patterns(spark, d).select("pattern", F.explode(P.packed(F.col("pattern"), "core")).alias("sub"))


@query("pattern_lcp", f"WITH {_P}, x AS (SELECT pattern, lag(pattern, 1, '') OVER (ORDER BY pattern) AS before FROM p) SELECT pattern, (SELECT count(*) FROM (SELECT unnest(range(1, length(pattern) + 1)) AS i) AS y WHERE left(pattern, i) = left(before, i) AND i <= length(before))::INT AS lcp FROM x")
def pattern_lcp(spark, d):
    """Longest common prefix with the pattern before, in code point order."""
    return R.neighbour_lcp(patterns(spark, d))


_CHAIN = f"""WITH {_P}, {_S}, c AS (SELECT DISTINCT {_canon('pattern')} AS q FROM p),
  x AS (SELECT q, unnest(range(1, length(q) + 1)) AS j FROM c),
  y AS (SELECT q, j, substr(q, j, 1) AS ch, regexp_replace(left(q, j - 1), '[%_]+$', '') AS done, regexp_extract(left(q, j - 1), '([%_]*)$', 1) AS gap FROM x WHERE substr(q, j, 1) NOT IN ('%', '_')),
  z AS (SELECT q, j, 0 AS b, done || '%' || ch || '%' AS step FROM y UNION ALL SELECT q, j, 1, done || gap || ch || '%' FROM y WHERE gap <> '%'
    UNION ALL SELECT q, length(q) + 1, 0, q FROM c WHERE regexp_extract(q, '([%_]*)$', 1) <> '%'),
  o AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY j, b) - 1 AS i, step FROM z),
  k AS (SELECT step, coalesce(sum(w), 0)::BIGINT AS card FROM (SELECT DISTINCT step FROM o) LEFT JOIN s ON s LIKE step GROUP BY 1),
  u AS (SELECT q, i, o.step, card, coalesce(lag(card) OVER (PARTITION BY q ORDER BY i), (SELECT sum(w) FROM s)) AS up FROM o JOIN k ON o.step = k.step),
  ch AS (SELECT q AS pattern, i::INT AS i, step, card, CASE WHEN up = 0 THEN 0.0 ELSE round(card / up::DOUBLE, 9) END AS ratio FROM u)"""


@query("conditional_chain", _CHAIN + " SELECT * FROM ch")
def conditional_chain(spark, d):
    """Ratios of the counts along each pattern's chain of steps. `%` alone has no step; a pattern of other wildcards alone has itself."""
    x = patterns(spark, d).select(P.canonical(F.col("pattern")).alias("pattern")).distinct()
    steps = x.select("pattern", F.posexplode(P.conditional_steps(F.col("pattern"))).alias("i", "step"))
    cards = C.typed(strings(spark, d), steps.select(F.col("step").alias("pattern"))).withColumnRenamed("pattern", "step")
    n = strings(spark, d).agg(F.sum("w").alias("n"))
    y = steps.join(cards, "step").crossJoin(F.broadcast(n)).withColumn("up", F.coalesce(F.lag("card").over(W.partitionBy("pattern").orderBy("i")), "n"))
    return y.select("pattern", "i", "step", "card", F.when(F.col("up") == 0, 0.0).otherwise(F.round(F.col("card") / F.nullif("up", F.lit(0)), 9)).alias("ratio"))


@query("chain_products", _CHAIN + " SELECT pattern, round(CASE WHEN min(ratio) <= 0 THEN 0 ELSE exp(sum(ln(greatest(ratio, 1e-300)))) END * (SELECT sum(w) FROM s), 4) AS est FROM ch GROUP BY 1")
def chain_products(spark, d):
    n = strings(spark, d).agg(F.sum("w")).first()[0]
    return R.chain_products(conditional_chain(spark, d), n).withColumn("est", F.round("est", 4))


@query("chain_loss", _CHAIN + ", l AS (SELECT ratio AS target, least(1 - 1e-7, greatest(1e-7, (card + 1) / ((SELECT sum(w) FROM s) + 2)::DOUBLE)) AS p FROM ch WHERE i < 6) SELECT count(*)::BIGINT AS n, round(avg(-(target * ln(p) + (1 - target) * ln(1 - p))), 6) AS loss FROM l")
def chain_loss(spark, d):
    """The masked loss of a model that knows a step's share alone, over the first six steps."""
    n = strings(spark, d).agg(F.sum("w")).first()[0]
    x = conditional_chain(spark, d).select(((F.col("card") + 1) / F.lit(float(n + 2))).alias("p"), F.col("ratio").alias("target"), (F.col("i") < 6).cast("int").alias("mask"))
    return R.chain_loss(x).withColumn("loss", F.round("loss", 6))


# --- predicates ----------------------------------------------------------------------------------------------------


@query("like_any_all", "SELECT p_partkey, (p_name LIKE 'red%' OR p_name LIKE '%bolt') AS any_hit, (p_name LIKE '%r%' AND p_name LIKE '%e%') AS all_hit, p_name NOT LIKE '%small%' AS none_hit FROM part")
def like_any_all(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", (n.like("red%") | n.like("%bolt")).alias("any_hit"), (n.like("%r%") & n.like("%e%")).alias("all_hit"), (~n.like("%small%")).alias("none_hit"))


_BITS = "SELECT md5(concat('0-', CAST(p_partkey AS VARCHAR))) AS o, p_partkey, p_name, p_size FROM part ORDER BY 1, 2 LIMIT 200"


@query("sample_bitmap", f"WITH b AS ({_BITS}), x AS (SELECT *, row_number() OVER (ORDER BY o, p_partkey) AS r, (p_name LIKE '%bolt%')::INT AS a, (p_size >= 25)::INT AS c FROM b) SELECT string_agg(a::VARCHAR, '' ORDER BY r) AS like_bits, string_agg(c::VARCHAR, '' ORDER BY r) AS size_bits, string_agg(least(a, c)::VARCHAR, '' ORDER BY r) AS and_bits, string_agg(greatest(a, c)::VARCHAR, '' ORDER BY r) AS or_bits FROM x")
def sample_bitmap(spark, d):
    b = S.sample(read(spark, d, "part"), "p_partkey", 200).withColumn("o", F.md5(F.concat(F.lit("0-"), F.col("p_partkey").cast("string")).cast("binary")))
    bits = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("o", "p_partkey", c.cast("int").alias("v")))), lambda s: s["v"])
    x = b.agg(bits(F.col("p_name").like("%bolt%")).alias("a"), bits(F.col("p_size") >= 25).alias("c"))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "")
    return x.select(text("a").alias("like_bits"), text("c").alias("size_bits"), text(F.zip_with("a", "c", lambda x, y: F.least(x, y))).alias("and_bits"), text(F.zip_with("a", "c", lambda x, y: F.greatest(x, y))).alias("or_bits"))


@query("negation_selectivity", "SELECT event_type, count(*) FILTER (props LIKE '%1%')::DOUBLE / count(*) AS sel_like, (count(*) - count(*) FILTER (props IS NULL) - count(*) FILTER (props LIKE '%1%'))::DOUBLE / count(*) AS sel_not_like FROM events GROUP BY 1")
def negation_selectivity(spark, d):
    like = F.count_if(F.col("props").like("%1%"))
    return read(spark, d, "events").groupBy("event_type").agg((like / F.count("*")).alias("sel_like"), ((F.count("*") - F.count_if(F.col("props").isNull()) - like) / F.count("*")).alias("sel_not_like"))


# --- positions -----------------------------------------------------------------------------------------------------

_TOK = "t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part)"


@query("token_postings", f"WITH {_TOK}, s AS (SELECT DISTINCT p_name AS s FROM part), x AS (SELECT token, s, unnest(range(1, length(s) - length(token) + 2)) AS p FROM t, s) SELECT token, s, string_agg(p::VARCHAR, ',' ORDER BY p) AS pos FROM x WHERE substr(s, p, length(token)) = token GROUP BY 1, 2")
def token_postings(spark, d):
    t = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    return C.postings(strings(spark, d), t).select("token", "s", F.array_join(F.transform("pos", lambda p: p.cast("string")), ",").alias("pos"))


for _op, _what in (("=", "eq"), (">=", "ineq")):
    query(
        f"position_join_{_what}",
        f"WITH s AS (SELECT DISTINCT p_name AS s FROM part), x AS (SELECT s, unnest(range(1, length(s) + 1)) AS p FROM s), a AS (SELECT s, p FROM x WHERE substr(s, p, 1) = 'l'), b AS (SELECT s, p FROM x WHERE substr(s, p, 1) = 'e') SELECT a.s, count(DISTINCT b.p)::BIGINT AS n_right FROM a JOIN b ON a.s = b.s AND b.p - a.p {_op} 2 GROUP BY 1",
    )(lambda spark, d, op=_op: _position_join(spark, d, op))


def _position_join(spark, d, op):
    s = strings(spark, d).withColumn("a", P.occurrences(F.col("s"), F.lit("l"))).withColumn("b", P.occurrences(F.col("s"), F.lit("e"))).where((F.size("a") > 0) & (F.size("b") > 0))
    right = F.array_intersect("b", F.transform("a", lambda p: p + 2)) if op == "=" else F.filter("b", lambda p: p >= F.array_min("a") + 2)
    return s.select("s", F.size(right).cast("long").alias("n_right")).where("n_right > 0")


# --- statistics ----------------------------------------------------------------------------------------------------

#: Longest grams of the n-gram tables.
GRAMS = 5
_NGRAM = f"""
WITH {_S}, g AS (
  SELECT s, w, n, i, substr(s, i, n) AS g FROM (SELECT s, w, n, unnest(range(1, length(s) - n + 2)) AS i FROM (SELECT s, w, unnest(range(1, least({GRAMS}, length(s)) + 1)) AS n FROM s))),
m AS (SELECT s, w, n, i, g, unnest(range(0, 1 << n::INT)) AS m FROM g),
k AS (SELECT s, w, n, i, array_to_string(list_transform(range(1, n + 1), lambda j: CASE WHEN (m >> (j - 1)::INT) % 2 = 1 THEN '{S.ANY}' ELSE substr(g, j, 1) END), '') AS x FROM m),
a AS (
  SELECT DISTINCT s, w, x AS gram FROM k UNION SELECT s, w, '{S.START}' || x FROM k WHERE i = 1 UNION SELECT s, w, x || '{S.END}' FROM k WHERE i = length(s) - n + 1
  UNION SELECT s, w, '{S.START}' || x || '{S.END}' FROM k WHERE i = 1 AND n = length(s) UNION SELECT s, w, '' FROM s),
t AS (SELECT gram, sum(w)::BIGINT AS cnt FROM a GROUP BY 1)"""


@query("ngram_table", _NGRAM + " SELECT gram, cnt FROM t")
def ngram_table(spark, d):
    return S.ngram_table(strings(spark, d), GRAMS)


@query("ngram_pruned_pt", _NGRAM + " SELECT gram, cnt FROM t WHERE cnt >= 20")
def ngram_pruned_pt(spark, d):
    return S.ngram_table(strings(spark, d), GRAMS).where("cnt >= 20")


@query("ngram_pruned_top", _NGRAM + f""", l AS (SELECT gram, cnt, length(translate(gram, '{S.START}{S.END}', '')) AS glen FROM t),
  e AS (SELECT floor(0.4 * count(*) FILTER (glen = 2))::BIGINT AS most FROM l),
  r AS (SELECT *, row_number() OVER (PARTITION BY glen ORDER BY cnt DESC, gram) - 1 AS rk FROM l),
  c AS (SELECT glen, coalesce(max(cnt) FILTER (rk = most) + 1, 1) AS pt FROM r, e GROUP BY 1)
  SELECT gram, l.glen::INT AS glen, cnt, pt::BIGINT AS pt FROM l JOIN c ON l.glen = c.glen WHERE cnt >= pt""")
def ngram_pruned_top(spark, d):
    return S.prune_top(S.ngram_table(strings(spark, d), GRAMS), 0.4).select("gram", "glen", "cnt", F.col("pt").cast("long").alias("pt"))


def _bound_sql(of: str = "p", least: str = "1", given: str = "0") -> str:
    """Steps that end in bd(pattern, bound) for the patterns of a table: the least count over the sub-grams of their parts. least: the shortest sub-grams; given: what an absent one counts."""
    return f"""
  bf AS (SELECT DISTINCT pattern, replace({_canon('pattern', True)}, '_', '{S.ANY}') AS q FROM {of}),
  bp AS (SELECT pattern, NOT starts_with(q, '%') AS l, NOT ends_with(q, '%') AS r, regexp_split_to_array(regexp_replace(q, '^%+|%+$', '', 'g'), '%+') AS bs FROM bf),
  bo AS (SELECT pattern, l, r, len(bs) AS k, unnest(bs) AS b, unnest(range(1, len(bs) + 1)) AS i FROM bp),
  bu AS (SELECT *, unnest(range({least}, least({GRAMS}, length(b)) + 1)) AS n FROM bo WHERE b <> ''),
  bv AS (SELECT *, unnest(range(1, length(b) - n + 2)) AS a FROM bu),
  bg AS (SELECT DISTINCT pattern, n, CASE WHEN l AND i = 1 AND a = 1 THEN '{S.START}' ELSE '' END || substr(b, a, n) || CASE WHEN r AND i = k AND a = length(b) - n + 1 THEN '{S.END}' ELSE '' END AS gram FROM bv),
  bl AS (SELECT pattern, min(coalesce(cnt, {given})) AS low FROM bg LEFT JOIN t ON bg.gram = t.gram GROUP BY 1),
  bd AS (SELECT bf.pattern, least(coalesce(low, n_all), n_all)::BIGINT AS bound FROM bf LEFT JOIN bl ON bf.pattern = bl.pattern, (SELECT cnt AS n_all FROM t WHERE gram = '') AS z),
  cd AS (SELECT {of}.pattern, coalesce(sum(w), 0)::BIGINT AS card FROM {of} LEFT JOIN s ON s LIKE {of}.pattern GROUP BY 1)"""


_BOUND = f"{_NGRAM}, {_P}, {_bound_sql()}"


@query("ngram_bound", _BOUND + " SELECT bd.pattern, bound, card, bound >= card AS ok FROM bd JOIN cd ON bd.pattern = cd.pattern")
def ngram_bound(spark, d):
    """Bounds beside the counts: ok says that the bound holds."""
    x = S.upper_bound(S.ngram_table(strings(spark, d), GRAMS), patterns(spark, d), GRAMS, 1)
    return x.join(C.naive(strings(spark, d), patterns(spark, d)), "pattern").withColumn("ok", F.col("bound") >= F.col("card"))


@query("bound_holds", _BOUND + " SELECT count(*)::BIGINT AS n, count(*) FILTER (bound >= card)::BIGINT AS n_ok, sum(bound)::BIGINT AS bounds FROM bd JOIN cd ON bd.pattern = cd.pattern")
def bound_holds(spark, d):
    return ngram_bound(spark, d).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.sum("bound").alias("bounds"))


#: Least counts by length of a gram.
THRESHOLDS = {1: 1, 2: 5, 3: 10, 4: 20, 5: 40}
_LEAST = "CASE n " + " ".join(f"WHEN {k} THEN {v}" for k, v in THRESHOLDS.items()) + " END"


@query("bound_by_length", f"{_NGRAM.replace('t AS (SELECT gram, sum(w)::BIGINT AS cnt FROM a GROUP BY 1)', '')} t0 AS (SELECT gram, sum(w)::BIGINT AS cnt, length(translate(gram, '{S.START}{S.END}', '')) AS n FROM a GROUP BY 1), t AS (SELECT gram, cnt FROM t0 WHERE n = 0 OR cnt >= {_LEAST}), {_P}, {_bound_sql(given=_LEAST + ' - 1')} SELECT bd.pattern, bound, bound >= card AS ok FROM bd JOIN cd ON bd.pattern = cd.pattern")
def bound_by_length(spark, d):
    """Bounds from a table with a least count for each length of a gram."""
    t = S.ngram_table(strings(spark, d), GRAMS).withColumn("n", S.gram_length(F.col("gram")))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), F.col("n"))
    t = t.where((F.col("n") == 0) | (F.col("cnt") >= least)).select("gram", "cnt")
    x = S.upper_bound(t, patterns(spark, d), GRAMS, THRESHOLDS)
    return x.join(C.naive(strings(spark, d), patterns(spark, d)), "pattern").select("pattern", "bound", (F.col("bound") >= F.col("card")).alias("ok"))


@query("bound_prefixes", f"{_NGRAM}, {_P}, px AS (SELECT pattern AS whole, {_canon('pattern', True)} AS q FROM p), py AS (SELECT whole, q, unnest(range(1, length(q) + 1)) AS i FROM px), pz AS (SELECT whole, i, left(q, i) AS prefix FROM py), o AS (SELECT DISTINCT prefix AS pattern FROM pz), {_bound_sql('o')}, h AS (SELECT pattern, regexp_replace(regexp_replace({_canon('pattern', True)}, '^%+', ''), '%+$', '') AS core FROM o), it AS (SELECT pattern, (length(core) BETWEEN 1 AND {GRAMS} AND NOT contains(core, '%') AND (SELECT count(*) FROM s WHERE s LIKE h.pattern) > 0) AS in_table FROM h) SELECT whole AS pattern, i::INT AS prefix_len, prefix, bound, in_table FROM pz JOIN bd ON prefix = bd.pattern JOIN it ON prefix = it.pattern")
def bound_prefixes(spark, d):
    """The bound of every prefix, and whether the table answers it by itself."""
    return S.prefix_bounds(S.ngram_table(strings(spark, d), GRAMS), patterns(spark, d), GRAMS, 1)


for _way, _part in (("prefix", "left(s, n)"), ("suffix", "right(s, n)")):
    query(f"{_way}_counts", f"WITH {_S} SELECT {_part} AS part, sum(w)::BIGINT AS card FROM (SELECT s, w, unnest(range(1, least(8, length(s)) + 1)) AS n FROM s) GROUP BY 1")(lambda spark, d, w=_way: S.summary(strings(spark, d), w))
query("substr_counts", f"WITH {_S}, x AS (SELECT s, w, i, unnest(range(1, least(8, length(s) - i + 1) + 1)) AS n FROM (SELECT s, w, unnest(range(1, length(s) + 1)) AS i FROM s)), y AS (SELECT DISTINCT s, w, substr(s, i, n) AS part FROM x) SELECT part, sum(w)::BIGINT AS card FROM y GROUP BY 1")(lambda spark, d: S.summary(strings(spark, d), "substring"))
query("transition_probs", f"WITH {_S}, n AS (SELECT left(s, n) AS child, sum(w) + 1 AS f FROM (SELECT s, w, unnest(range(1, least(8, length(s)) + 1)) AS n FROM s) GROUP BY 1), e AS (SELECT child, left(child, length(child) - 1) AS parent, f FROM n) SELECT parent, child, round(f / sum(f) OVER w * CASE WHEN length(parent) <= 1 THEN 1.0::DOUBLE ELSE count(*) OVER w / (count(*) OVER w + 1)::DOUBLE END, 9) AS p FROM e WINDOW w AS (PARTITION BY parent)")(lambda spark, d: S.transitions(strings(spark, d)).withColumn("p", F.round("p", 9)))


@query("char_stats", f"WITH {_S}, x AS (SELECT s, w, unnest(string_split(s, '')) AS ch FROM s), y AS (SELECT s, w, ch, count(*) AS n FROM x GROUP BY ALL), z AS (SELECT ch, sum(n * w)::BIGINT AS n_occ, sum(w)::BIGINT AS n_rec, coalesce(sum(w) FILTER (left(s, 1) = ch), 0)::BIGINT AS n_pre, coalesce(sum(w) FILTER (right(s, 1) = ch), 0)::BIGINT AS n_suf FROM y GROUP BY 1) SELECT *, (row_number() OVER (ORDER BY n_occ DESC, ch) - 1)::INT AS idx FROM z")
def char_stats(spark, d):
    return S.char_stats(strings(spark, d))


_A, _B = [48271, 69621, 16807, 39373], [11, 1009, 70001, 900001]


@query("minhash_signatures", "WITH x AS (SELECT DISTINCT s_suppkey AS rid, substr(s_name, i, n) AS gram FROM (SELECT *, unnest(range(1, least(3, length(s_name) - i + 1) + 1)) AS n FROM (SELECT s_suppkey, s_name, unnest(range(1, length(s_name) + 1)) AS i FROM supplier))) SELECT gram, count(*)::BIGINT AS cnt, " + ", ".join(f"min((rid * {a} + {b}) % 2147483647)::BIGINT AS h{i + 1}" for i, (a, b) in enumerate(zip(_A, _B, strict=True))) + " FROM x GROUP BY 1")
def minhash_signatures(spark, d):
    r = read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("rid"), F.col("s_name").alias("s"))
    return S.minhash_signatures(r.select("rid", "s"), 3, _A, _B).select("gram", "cnt", *[F.col(f"h{i + 1}").cast("long").alias(f"h{i + 1}") for i in range(len(_A))])


_EST = f"""WITH {_P}, b AS ({_BITS}), c AS (SELECT count(*) AS n FROM part), {_S},
 k AS (SELECT pattern, count(p_name) AS k FROM p LEFT JOIN b ON p_name LIKE pattern GROUP BY 1),
 e AS (SELECT pattern, k::BIGINT AS k, CASE WHEN k = 0 THEN 0.5::DOUBLE ELSE k END * n / 200 AS est FROM k, c)"""


def _estimates(spark, d):
    part = read(spark, d, "part")
    return S.est_s(S.sample(part, "p_partkey", 200).select(F.col("p_name").alias("s")), patterns(spark, d), part.count(), 200)


query("sample_est_s", _EST + " SELECT * FROM e")(_estimates)


@query("qerror_stats", _EST + ", t AS (SELECT pattern, coalesce(sum(w), 0) AS c FROM p LEFT JOIN s ON s LIKE pattern GROUP BY 1), q AS (SELECT greatest(greatest(c, 1)::DOUBLE / greatest(est, 1), greatest(est, 1)::DOUBLE / greatest(c, 1)) AS q, c, est FROM e JOIN t USING (pattern)) SELECT round(avg(q), 6) AS avg_q, round(quantile_cont(q, 0.5), 6) AS q050, round(quantile_cont(q, 0.9), 6) AS q090, round(quantile_cont(q, 0.99), 6) AS q099, round(max(q), 6) AS q100, round(exp(avg(ln(q))), 6) AS geo_q, round(avg(pow(ln(1 + greatest(est, 1e-7)) - ln(1 + greatest(c, 1e-7)), 2)), 6) AS msle FROM q")
def qerror_stats(spark, d):
    x = _estimates(spark, d).join(C.naive(strings(spark, d), patterns(spark, d)).withColumnRenamed("card", "true"), "pattern")
    y = S.q_error_stats(x.select("true", "est"))
    return y.select(*[F.round(k, 6).alias(k) for k in y.columns])


@query("parity_score", _EST + ", t AS (SELECT pattern, coalesce(sum(w), 0) AS c FROM p LEFT JOIN s ON s LIKE pattern GROUP BY 1), q AS (SELECT c, est FROM e JOIN t USING (pattern)) SELECT round(avg(((a.c < b.c) = (a.est < b.est))::INT), 9) AS parity FROM q a, q b WHERE a.c <> b.c")
def parity_score(spark, d):
    x = _estimates(spark, d).join(C.naive(strings(spark, d), patterns(spark, d)).withColumnRenamed("card", "true"), "pattern")
    return E.parity(x).select(F.round("parity", 9).alias("parity"))


@query("sample_est_plain", _EST + " SELECT e.pattern, k, k * n / 200.0::DOUBLE AS est FROM e, c")
def sample_est_plain(spark, d):
    part = read(spark, d, "part")
    return S.est_plain(S.sample(part, "p_partkey", 200).select(F.col("p_name").alias("s")), patterns(spark, d), part.count(), 200)


@query("qerror_percentiles", _EST + ", t AS (SELECT pattern, coalesce(sum(w), 0) AS c FROM p LEFT JOIN s ON s LIKE pattern GROUP BY 1), q AS (SELECT greatest(greatest(c, 1)::DOUBLE / greatest(est, 1), greatest(est, 1)::DOUBLE / greatest(c, 1)) AS q FROM e JOIN t USING (pattern)), l AS (SELECT quantile_cont(q, list_transform(range(1, 101), lambda i: i / 100)) AS qs FROM q) SELECT unnest(range(1, 101))::INT AS p, round(unnest(qs), 6) AS q FROM l")
def qerror_percentiles(spark, d):
    x = _estimates(spark, d).join(C.naive(strings(spark, d), patterns(spark, d)).withColumnRenamed("card", "true"), "pattern")
    return S.q_error_percentiles(x).withColumn("q", F.round("q", 6))


_LIKELY = "lgamma(size + 1) - lgamma(k + 1) - lgamma(size - k + 1) + lgamma(n - size + 1) - lgamma(200 - k + 1) - lgamma(n - size - 200 + k + 1) - (lgamma(n + 1) - lgamma(201) - lgamma(n - 199))"


@query("sample_est_m", _EST + f", ks AS (SELECT DISTINCT k, n FROM e, c WHERE k > 0), z AS (SELECT k, n, unnest(range(k, n - 200 + k + 1)) AS size FROM ks), i AS (SELECT k, sqrt(greatest(min(size), 1) * max(size)) AS mid FROM z WHERE {_LIKELY} >= ln(1e-5) GROUP BY 1) SELECT pattern, e.k, CASE WHEN e.k = 0 THEN 0.5::DOUBLE ELSE mid END AS est FROM e LEFT JOIN i ON e.k = i.k")
def sample_est_m(spark, d):
    return E.est_m(_estimates(spark, d), read(spark, d, "part").count(), 200)


@query("sample_est_b", None)
def sample_est_b(spark, d):
    part = read(spark, d, "part")
    n, m = part.count(), 150
    r = F.row_number().over(W.orderBy(F.md5(F.concat(F.lit("0-"), F.col("p_partkey").cast("string")).cast("binary")), "p_partkey"))
    sampled = S.sample(part, "p_partkey", m).select(r.cast("long").alias("r"), F.col("p_name").alias("s"))
    return E.est_b(sampled, patterns(spark, d), E.break_table(n, 2.0, m), n)


_UNION = """, q(pattern, gram) AS (VALUES ('%Sup%00%', 'Sup'), ('%Sup%00%', '00'), ('%0%1%', '0'), ('%0%1%', '1')),
  j AS (SELECT q.pattern, m.* FROM q JOIN m ON q.gram = m.gram),
  g AS (SELECT pattern, count(*) AS n_parts, max(cnt) AS largest, max({'c': cnt, 'h1': h1, 'h2': h2, 'h3': h3, 'h4': h4}) AS top, min(h1) AS h1, min(h2) AS h2, min(h3) AS h3, min(h4) AS h4 FROM j GROUP BY 1)
  SELECT pattern, n_parts::BIGINT AS n_parts, largest, ((top.h1 = h1)::INT + (top.h2 = h2)::INT + (top.h3 = h3)::INT + (top.h4 = h4)::INT) / 4.0::DOUBLE AS similarity FROM g"""


@query("union_estimate", f"WITH m AS ({SQL['minhash_signatures']}){_UNION}")
def union_estimate(spark, d):
    parts = spark.createDataFrame([("%Sup%00%", "Sup"), ("%Sup%00%", "00"), ("%0%1%", "0"), ("%0%1%", "1")], "pattern string, gram string")
    return E.union_estimate(minhash_signatures(spark, d), parts, len(_A))


_TRANSITIONS = SQL["transition_probs"].replace("round(f / sum(f) OVER w * ", "(f / sum(f) OVER w * ").replace("END, 9) AS p", "END) AS p")


@query("triplets", f"WITH tr AS ({_TRANSITIONS}), b AS (SELECT parent, max({{'p': p, 'child': child}}).child AS positive FROM tr GROUP BY 1), r AS (SELECT parent, positive, row_number() OVER (ORDER BY md5('0-' || parent), parent) - 1 AS k, count(*) OVER () AS n FROM b) SELECT x.parent AS anchor, x.positive, y.positive AS negative FROM r x JOIN r y ON (x.k + 1) % x.n = y.k WHERE x.n > 1")
def triplets(spark, d):
    return E.triplets(S.transitions(strings(spark, d)))


_STEPS = f"""WITH tr AS ({_TRANSITIONS}), kk AS (SELECT parent, count(*) AS k FROM tr GROUP BY 1),
  one AS (SELECT parent AS node, child AS near, p FROM tr WHERE parent <> '' UNION ALL SELECT child, tr.parent, 1.0::DOUBLE / (coalesce(k, 0) + 1) FROM tr LEFT JOIN kk ON kk.parent = child WHERE tr.parent <> ''),
  both_ AS (SELECT node, near, p FROM one UNION ALL SELECT a.node, b.near, a.p * b.p FROM one a JOIN one b ON a.near = b.node),
  st AS (SELECT node, near, sum(p) AS p FROM both_ GROUP BY 1, 2)"""


@query("triplet_steps", _STEPS + " SELECT node, near, round(p / sum(p) OVER (PARTITION BY node) + 1e-13, 9) AS p FROM st")
def triplet_steps(spark, d):
    """Probabilities of walks of one and two steps in the prefix tree."""
    return E.steps(S.transitions(strings(spark, d))).withColumn("p", F.round(F.col("p") + 1e-13, 9))  # off ties, which the engines round differently


@query("triplets_drawn", None)
def triplets_drawn(spark, d):
    return E.drawn_triplets(S.transitions(strings(spark, d)))


@query("iqr_mean", "WITH q AS (SELECT quantile_cont(p_retailprice::DOUBLE, 0.25) AS a, quantile_cont(p_retailprice::DOUBLE, 0.75) AS b FROM part) SELECT round(avg(p_retailprice::DOUBLE), 6) AS iqr_mean, count(*)::BIGINT AS n FROM part, q WHERE p_retailprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def iqr_mean(spark, d):
    return S.iqr_mean(read(spark, d, "part"), "p_retailprice").select(F.round("iqr_mean", 6).alias("iqr_mean"), "n")


@query("workload_split", f"WITH {_P}, r AS (SELECT pattern, row_number() OVER (ORDER BY md5('0-' || pattern), pattern) - 1 AS r, count(*) OVER () AS n FROM p) SELECT pattern, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.9) THEN 'valid' ELSE 'test' END AS split FROM r")
def workload_split(spark, d):
    x, r, n = S.shuffled_rank(patterns(spark, d), "pattern"), F.col("rank"), F.col("total")
    return x.select("pattern", F.when(r < F.floor(n * 0.8), "train").when(r < F.floor(n * 0.9), "valid").otherwise("test").alias("split"))


@query("two_word_patterns", "WITH w AS (SELECT DISTINCT string_split(p_name, ' ') AS w FROM part) SELECT DISTINCT '%' || left(w[1], n) || '%' || left(w[2], n) || '%' AS pattern FROM (SELECT w, unnest([2, 3]) AS n FROM w WHERE len(w) >= 2)")
def two_word_patterns(spark, d):
    w = strings(spark, d).select(F.split("s", " ").alias("w")).where(F.size("w") >= 2).withColumn("n", F.explode(F.array(F.lit(2), F.lit(3))))
    cut = lambda i: F.substr(F.get("w", F.lit(i)), F.lit(1), F.col("n"))
    return w.select(F.concat(F.lit("%"), cut(0), F.lit("%"), cut(1), F.lit("%")).alias("pattern")).distinct()


_SMALL = f"""f AS (SELECT pattern, {_canon('pattern', True)} AS c FROM p), h AS (SELECT pattern, c, regexp_replace(regexp_replace(c, '^%+', ''), '%+$', '') AS core FROM f)"""


@query("ngram_exact_hits", _NGRAM + f", {_P}, {_SMALL} SELECT pattern, CASE WHEN length(core) BETWEEN 1 AND {GRAMS} AND NOT contains(core, '%') THEN (SELECT sum(w) FROM s WHERE s LIKE pattern)::BIGINT END AS cnt FROM h")
def ngram_exact_hits(spark, d):
    """Patterns that the n-gram table answers exactly; SQL counts them."""
    return R.exact_hits(S.ngram_table(strings(spark, d), GRAMS), patterns(spark, d), GRAMS)


@query("bound_report", _BOUND + ", r AS (SELECT bound, card, CASE WHEN card > 0 THEN bound / card::DOUBLE END AS ratio FROM bd JOIN cd ON bd.pattern = cd.pattern) SELECT round(avg(ratio), 6) AS avg_ratio, round(stddev_pop(ratio), 6) AS std_ratio, round(max(ratio), 6) AS max_ratio, count(*) FILTER (bound < card) = 0 AS holds FROM r")
def bound_report(spark, d):
    x = R.bound_report(S.upper_bound(S.ngram_table(strings(spark, d), GRAMS), patterns(spark, d), GRAMS, 1), C.naive(strings(spark, d), patterns(spark, d)))
    return x.select(*[F.round(k, 6).alias(k) for k in ("avg_ratio", "std_ratio", "max_ratio")], "holds")


@query("negated_estimates", _EST + ", u AS (SELECT count(*) AS n, count(*) - count(p_name) AS nulls FROM part) SELECT pattern, est, greatest(0, n - nulls - est) AS est_not_like, greatest(0, n - est) AS est_not_equal FROM e, u")
def negated_estimates(spark, d):
    u = read(spark, d, "part").agg(F.count("*").alias("n"), F.count_if(F.col("p_name").isNull()).alias("nulls"))
    return R.negated(_estimates(spark, d).crossJoin(F.broadcast(u)), F.col("n"), F.col("nulls")).select("pattern", "est", "est_not_like", "est_not_equal")


@query("pattern_encoded", f"WITH {_P}, {_S}, x AS (SELECT w, unnest(string_split(s, '')) AS ch FROM s), y AS (SELECT ch, row_number() OVER (ORDER BY sum(w) DESC, ch) AS id FROM x GROUP BY 1), c AS (SELECT DISTINCT pattern, {_canon('pattern')} AS canonical FROM p), u AS (SELECT (SELECT max(length(canonical)) FROM c) AS width, (SELECT max(id) + 1 FROM y) AS unknown), z AS (SELECT pattern, canonical, unnest(range(1, length(canonical) + 1)) AS i FROM c), g AS (SELECT pattern, string_agg(coalesce(id, unknown)::VARCHAR, ',' ORDER BY i) AS ids FROM z LEFT JOIN y ON substr(canonical, i, 1) = ch, u GROUP BY 1) SELECT c.pattern, canonical, length(canonical)::INT AS len, coalesce(ids, '0') || repeat(',0', (width - greatest(1, length(canonical)))::INT) AS ids FROM c LEFT JOIN g ON c.pattern = g.pattern, u")
def pattern_encoded(spark, d):
    x = R.encoded(patterns(spark, d), S.char_stats(strings(spark, d)))
    return x.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query("prefix_label_map", f"WITH {_P}, {_S}, c AS (SELECT DISTINCT {_canon('pattern')} AS pattern FROM p), x AS (SELECT pattern, unnest(range(1, length(pattern) + 1)) AS i FROM c), y AS (SELECT pattern, i, left(pattern, i) AS prefix FROM x), l AS (SELECT p.pattern AS prefix, coalesce(sum(w), 0) AS card FROM p LEFT JOIN s ON s LIKE p.pattern GROUP BY 1) SELECT pattern, i::INT AS i, y.prefix, coalesce(card, 0)::BIGINT AS card, (card IS NOT NULL)::INT AS mask FROM y LEFT JOIN l ON y.prefix = l.prefix")
def prefix_label_map(spark, d):
    return R.prefix_labels(patterns(spark, d), C.typed(strings(spark, d), patterns(spark, d)))


@query("tokens_in_any_order", f"WITH {_P}, {_S} SELECT pattern, coalesce(sum(w), 0)::BIGINT AS n FROM p LEFT JOIN s ON len(list_filter(regexp_extract_all(pattern, '[^%_]+'), lambda t: NOT contains(s, t))) = 0 GROUP BY 1")
def tokens_in_any_order(spark, d):
    return R.all_tokens_occur(strings(spark, d), patterns(spark, d))


@query("token_sentences", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda t: t <> ''), lambda t: 'p_name_' || t), ' ') AS sentence FROM part")
def token_sentences(spark, d):
    """Rows as sentences of column and token, for token dictionaries."""
    t = F.filter(F.split(F.col("p_name"), " ", -1), lambda t: t != "")
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(t, lambda t: F.concat(F.lit("p_name_"), t)), " ").alias("sentence"))


@query("row_counts", "SELECT count(*)::BIGINT AS n_all, count(p_name)::BIGINT AS n_name, count(p_brand)::BIGINT AS n_brand, max(length(p_name))::INT AS longest FROM part")
def row_counts(spark, d):
    return read(spark, d, "part").agg(F.count("*").alias("n_all"), F.count("p_name").alias("n_name"), F.count("p_brand").alias("n_brand"), F.max(F.length("p_name")).alias("longest"))


@query("distinct_prefixes", f"WITH {_P}, x AS (SELECT pattern, unnest(range(1, length(pattern) + 1)) AS i FROM p) SELECT count(DISTINCT left(pattern, i))::BIGINT AS n FROM x")
def distinct_prefixes(spark, d):
    """Nodes of the patterns' trie."""
    return patterns(spark, d).select(F.explode(P.prefixes(F.col("pattern"))).alias("x")).agg(F.count_distinct("x").alias("n"))


@query("shape_lengths", f"WITH {_P}, x AS (SELECT regexp_replace(pattern, '[^%_]+', 'w', 'g') AS shape, array_to_string(list_transform(regexp_extract_all(pattern, '[^%_]+'), lambda t: length(t)::VARCHAR), ',') AS lens FROM p) SELECT shape, count(*)::BIGINT AS n, string_agg(DISTINCT lens, ';' ORDER BY lens) AS lengths FROM x GROUP BY 1")
def shape_lengths(spark, d):
    lens = F.array_join(F.transform(P.tokens(F.col("pattern")), lambda t: F.length(t).cast("string")), ",")
    x = patterns(spark, d).select(P.shape(F.col("pattern")).alias("shape"), lens.alias("lens"))
    return x.groupBy("shape").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("lens")), ";").alias("lengths"))


@query("char_vocabulary", f"WITH {_S}, x AS (SELECT w, unnest(string_split(s, '')) AS ch FROM s) SELECT ch, (row_number() OVER (ORDER BY sum(w) DESC, ch) - 1)::INT AS idx FROM x GROUP BY 1 QUALIFY idx < 200")
def char_vocabulary(spark, d):
    return R.vocabulary(strings(spark, d))


@query("log_scaled_cards", f"WITH {_P}, {_S}, c AS (SELECT pattern, coalesce(sum(w), 0)::BIGINT AS card FROM p LEFT JOIN s ON s LIKE pattern GROUP BY 1), m AS (SELECT ln(greatest(min(card), 1)::DOUBLE) AS a, ln(greatest(max(card), 1)::DOUBLE) AS b FROM c) SELECT pattern, card, round(coalesce((ln(greatest(card, 1)::DOUBLE) - a) / nullif(b - a, 0), 0), 9) AS scaled FROM c, m")
def log_scaled_cards(spark, d):
    return R.log_scaled(C.naive(strings(spark, d), patterns(spark, d)), "card").withColumn("scaled", F.round("scaled", 9))


_JOIN_TEXT = "SELECT count(*) FROM nation n, region r, customer c WHERE n.n_regionkey = r.r_regionkey AND c.c_nationkey = n.n_nationkey AND n.n_name LIKE '%AN%' AND c.c_acctbal BETWEEN 0 AND 5000"
_SUBPLANS = sqltext.subplan_sql(_JOIN_TEXT)


@query("subplan_sql", " UNION ALL ".join(f"SELECT '{k}' AS subplan, card FROM ({q}) AS x{i}" for i, (k, q) in enumerate(_SUBPLANS.items())))
def subplan_sql(spark, d):
    """Counts of the sub-plans that a join query's text gives."""
    return views(spark, d).sql(" UNION ALL ".join(f"SELECT '{k}' AS subplan, card FROM ({q})" for k, q in _SUBPLANS.items()))


# --- joins with patterns: text that both engines read alike, on Catalyst --------------------------------------------

JOINS = {
    "join_star_like": "SELECT count(*) AS n, min(p_name) AS name, min(s_name) AS supplier FROM lineitem, part, supplier, nation WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND p_name LIKE '%bolt%' AND n_name LIKE '%A%'",
    "join_star_not_like": "SELECT n_name, count(*) AS n FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND o_orderpriority NOT LIKE '%URGENT%' AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY n_name",
    "join_chain_between": "SELECT r_name, count(*) AS n, min(o_orderdate) AS first_date FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderdate BETWEEN timestamp '1994-01-01 00:00:00' AND timestamp '1996-12-31 00:00:00' GROUP BY r_name",
    "join_or_null": "SELECT count(*) AS n FROM part, lineitem WHERE p_partkey = l_partkey AND (p_name LIKE 'red%' OR p_name LIKE '%gear' OR p_name IS NULL) AND l_returnflag <> 'N'",
    "join_self_alias": "SELECT count(*) AS n FROM nation n1, nation n2, region r WHERE n1.n_regionkey = r.r_regionkey AND n2.n_regionkey = r.r_regionkey AND n1.n_name < n2.n_name AND n1.n_name LIKE '%I%'",
    "join_hub": sqltext.hub("SELECT count(*) AS n FROM orders o, documents d WHERE o.o_custkey = d.doc_id AND d.text LIKE '%the%' AND o.o_orderpriority LIKE '1%'", "customer", "c_custkey"),
    "join_wide": "SELECT count(*) AS n, min(p.p_name) AS name, max(c2.c_name) AS customer FROM lineitem l, orders o, customer c, nation n1, region r1, supplier s, nation n2, region r2, part p, nation n3, region r3, nation n4, region r4, customer c2, orders o2, supplier s2, part p2 WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n1.n_nationkey AND n1.n_regionkey = r1.r_regionkey AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND l.l_partkey = p.p_partkey AND n3.n_nationkey = n1.n_nationkey AND n3.n_regionkey = r3.r_regionkey AND n4.n_nationkey = n2.n_nationkey AND n4.n_regionkey = r4.r_regionkey AND c2.c_custkey = c.c_custkey AND o2.o_orderkey = o.o_orderkey AND s2.s_suppkey = s.s_suppkey AND p2.p_partkey = p.p_partkey AND p2.p_name LIKE '%b%' AND r3.r_name LIKE 'A%' AND n4.n_name NOT LIKE '%Z%' AND o2.o_orderpriority LIKE '%H%' AND c2.c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "join_semi_anti": "SELECT (SELECT count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS n_semi, (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS n_anti",
    "label_lookup": "SELECT toxic, quality, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text LIKE '%e%' GROUP BY toxic, quality",
    "line_view": "SELECT count(*) AS n, CAST(sum(CASE WHEN url LIKE 'http%' THEN 1 ELSE 0 END) AS BIGINT) AS n_http FROM pages",
    "clip_by_length": "SELECT CAST(length(p_name) AS BIGINT) AS len, count(*) AS n, count(DISTINCT p_name) AS n_distinct FROM part WHERE length(p_name) BETWEEN 5 AND 12 GROUP BY length(p_name)",
    "set_operations": "SELECT n_name AS name FROM nation WHERE n_name LIKE '%A%' INTERSECT SELECT n_name FROM nation WHERE n_name LIKE '%I%' EXCEPT SELECT n_name FROM nation WHERE n_name LIKE 'C%'",
}
for _name, _text in JOINS.items():
    query(_name, _text)(lambda spark, d, t=_text: views(spark, d).sql(t))


@query("subplan_counts", " UNION ALL ".join(
    f"SELECT '{k}' AS subplan, count(*)::BIGINT AS card FROM {t} WHERE {w}"
    for k, t, w in (
        ("p", "part p", "p_name LIKE '%bolt%'"), ("l", "lineitem l", "l_returnflag = 'R'"), ("o", "orders o", "o_orderpriority LIKE '1%'"),
        ("pl", "part p, lineitem l", "p_partkey = l_partkey AND p_name LIKE '%bolt%' AND l_returnflag = 'R'"),
        ("lo", "lineitem l, orders o", "l_orderkey = o_orderkey AND l_returnflag = 'R' AND o_orderpriority LIKE '1%'"),
        ("plo", "part p, lineitem l, orders o", "p_partkey = l_partkey AND l_orderkey = o_orderkey AND p_name LIKE '%bolt%' AND l_returnflag = 'R' AND o_orderpriority LIKE '1%'"))))
def subplan_counts(spark, d):
    """Counts of all connected sub-plans of a three-way join, built from its filters and join conditions."""
    from .plans.subplans import subplans

    plan = subplans(
        {"p": read(spark, d, "part"), "l": read(spark, d, "lineitem"), "o": read(spark, d, "orders")},
        {"p": F.col("p_name").like("%bolt%"), "l": F.col("l_returnflag") == "R", "o": F.col("o_orderpriority").like("1%")},
        [("p", "p_partkey", "l", "l_partkey"), ("l", "l_orderkey", "o", "o_orderkey")],
    )
    out = None
    for name, df in plan.items():
        x = df.agg(F.lit(name).alias("subplan"), F.count("*").alias("card"))
        out = x if out is None else out.unionAll(x)
    return out


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return grams.windowed(read(spark, d, "events"), "ts", "event_type")


@query("gram_counts", "SELECT gram, count(*)::BIGINT AS cnt FROM (SELECT DISTINCT p_partkey, substr(p_name, i, 3) AS gram FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part)) GROUP BY 1")
def gram_counts(spark, d):
    return grams.gram_counts(read(spark, d, "part"), "p_name")
