"""Every registered query against its SQL, and the engines against one another."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from globmill import engine_queries, queries, workload_queries
from globmill.functions import language as L
from globmill.functions import patterns as P
from globmill.operators import counting as C
from globmill.operators import estimators as E
from globmill.operators import hybrid as H
from globmill.operators import statistics as S
from globmill.operators import workloads as W
from globmill.plans import features, sqltext
from globmill.sources import files
from globmill.streaming import grams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in queries.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(got.columns) == sorted(names)
    a, b = sorted((tuple(r[k] for k in names) for r in got.collect()), key=_key), sorted(cur.fetchall(), key=_key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9) for p, q in zip(x, y, strict=True)), (x, y)


CORPUS = ["red bolt", "red widget", "blue bolt", "bold", "", "red bolt"]
CARDS = {"%bol%": 4, "red%": 3, "%t": 4, "re_%t": 3, "____": 1, "%": 6, "%d%bolt": 2, "%a.b%": 0, "a\\_b": 0, "%o__%": 4, "": 1, "%l%l%": 1, "bol_": 1}


@pytest.mark.parametrize("engine", [C.naive, C.candidates, C.typed, C.positional])
def test_engines(spark, engine):
    strings = C.weighted(spark.createDataFrame([(s,) for s in CORPUS], "x string"), "x")
    got = {r["pattern"]: r["card"] for r in engine(strings, spark.createDataFrame([(p,) for p in CARDS], "pattern string")).collect()}
    want = {p: sum(duckdb.execute("select ? like ?", [s, p]).fetchone()[0] for s in CORPUS) for p in CARDS}
    assert got == want and all(want[p] == n for p, n in CARDS.items())


def test_canonical_forms(spark):
    rows = [("a_%b", "a%_b", "a%_b"), ("a%%b", "a%b", "a%b"), ("a%_", "a%_", "a_%"), ("%__", "%__", "__%"), ("__", "__", "__"), ("_%_x", "%__x", "%__x"), ("", "", "")]
    got = spark.createDataFrame(rows, "q string, a string, b string").select("a", "b", P.canonical(F.col("q")).alias("c"), P.canonical(F.col("q"), True).alias("d")).collect()
    assert all(r["a"] == r["c"] and r["b"] == r["d"] for r in got)


def test_augmentations(spark):
    one = spark.createDataFrame([("%ab%",)], "q string").select(P.prefixes(F.col("q")), P.delimiter(F.col("q")), P.placeholder(F.col("q"))).first()
    assert one[0] == ["%", "%a", "%ab", "%ab%"] and one[1] == ["%", "%a%", "%ab%", "%ab%"] and one[2] == ["__%", "%a_%", "%ab%", "%ab%"]


def test_conditional_chain(spark):
    q = spark.createDataFrame([("ab%",), ("ab",), ("%a%b%",), ("%a_b",)], "q string").select(P.conditional_steps(F.col("q"))).collect()
    assert [r[0] for r in q] == [["%a%", "a%", "a%b%", "ab%"], ["%a%", "a%", "a%b%", "ab%", "ab"], ["%a%", "%a%b%"], ["%a%", "%a%b%", "%a_b%", "%a_b"]]
    rows = queries.conditional_chain(spark, SF).collect()
    n = sum(r["w"] for r in queries.strings(spark, SF).collect())
    by = {}
    for r in rows:
        by.setdefault(r["pattern"], []).append(r)
    for steps in by.values():
        last = max(steps, key=lambda r: r["i"])
        assert last["step"] == last["pattern"] and abs(math.prod(r["ratio"] for r in steps) * n - last["card"]) < 1e-3


def test_bound_and_reversal(spark):
    assert all(r["ok"] for r in queries.ngram_bound(spark, SF).collect())
    s, p = queries.strings(spark, SF), queries.patterns(spark, SF)
    r = {x["pattern"][::-1]: x["card"] for x in C.naive(*C.reverse_both(s, p)).collect()}
    assert r == {x["pattern"]: x["card"] for x in C.naive(s, p).collect()}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([('a,"b"%', 3), ("%x%", 0)], "pattern string, card long")
    files.write_labelled(df, str(tmp_path / "l"))
    assert sorted(files.labelled(spark, str(tmp_path / "l")).collect()) == sorted(df.collect())
    assert files.workload(spark, {"train": str(tmp_path / "l"), "test": str(tmp_path / "l")}).groupBy("split").count().count() == 2
    (tmp_path / "t.txt").write_text("a\n\nb\n")
    assert [r["s"] for r in files.lines(spark, str(tmp_path / "t.txt")).collect()] == ["a", "", "b"]
    (tmp_path / "d.csv").write_text("p,c0,c1\n%a%,1,2\n")
    assert files.distances(spark, str(tmp_path / "d.csv"), 1).first()["cards"] == [1, 2]
    files.write_estimates(spark.createDataFrame([("%a%", 4, 2.0)], "query string, true long, est double"), str(tmp_path / "e"))


def test_stream(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/part.parquet").select("p_name")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = grams.gram_counts(stream, "p_name").writeStream.format("memory").queryName("gram_stream").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("gram_stream").collect()) == sorted(grams.gram_counts(src, "p_name").collect())


def test_metrics(spark):
    x = spark.createDataFrame([(4, 2.0), (0, 0.5), (10, 40.0)], "true long, est double")
    r = S.q_error_stats(x).first()
    assert math.isclose(r["avg_q"], (2 + 1 + 4) / 3) and r["q100"] == 4


def test_sampling_intervals():
    for n, m, k in ((40, 10, 0), (40, 10, 3), (60, 25, 25), (60, 7, 1)):
        good = [s for s in range(n + 1) if E.likelihood(n, m, k, s) >= math.log(1e-3)]
        assert E.interval(n, m, k, 1e-3) == (good[0], good[-1])
        whole = sum(math.comb(s, k) * math.comb(n - s, m - k) / math.comb(n, m) for s in good)
        assert math.isclose(sum(math.exp(E.likelihood(n, m, k, s)) for s in good), whole)


def test_sequential_estimates(spark):
    """The same as reading the sample row by row."""
    breaks = E.break_table(200, 2.0, 150)
    need = lambda m: [z for at, z in breaks if at <= m][-1]
    rows = [(i + 1, r["p_name"]) for i, r in enumerate(S.sample(spark.read.parquet(f"{SF}/part.parquet"), "p_partkey", 150).orderBy(F.md5(F.concat(F.lit("0-"), F.col("p_partkey").cast("string")).cast("binary")), "p_partkey").collect())]
    for r in queries.sample_est_b(spark, SF).collect():
        k = 0
        for m, s in rows:
            k += duckdb.execute("select ? like ?", [s, r["pattern"]]).fetchone()[0]
            if 0 < k >= need(m):
                break
        assert (r["m"], r["k"]) == (m, k), r


def test_estimator_queries(spark):
    assert all(0 <= r["similarity"] <= 1 for r in queries.union_estimate(spark, SF).collect())
    assert all(r["positive"] != r["negative"] for r in queries.triplets(spark, SF).collect())
    assert all(r["est"] > 0 for r in queries.sample_est_m(spark, SF).collect())


def test_bound_report(spark):
    r = queries.bound_report(spark, SF).first()
    assert r["holds"] and r["max_ratio"] >= r["avg_ratio"] >= 1


def test_join_text():
    tables, filters, joins = sqltext.split("SELECT count(*) FROM title AS t, cast_info ci WHERE t.id=ci.movie_id AND (t.note LIKE '% AND %' OR t.x = 1) AND t.y BETWEEN 1 AND 2 AND ci.z = 'a.b';")
    assert tables == {"t": "title", "ci": "cast_info"} and joins == [("t", "id", "ci", "movie_id")]
    assert filters == ["(t.note LIKE '% AND %' OR t.x = 1)", "t.y BETWEEN 1 AND 2", "ci.z = 'a.b'"]
    assert sqltext.sql_operators("a.b !~~ 'x ~~ y' and a.c ~~ 'z' and a.d <> 1") == "a.b NOT LIKE 'x ~~ y' and a.c LIKE 'z' and a.d != 1"
    assert list(sqltext.subplan_sql("SELECT 1 FROM a x, b y, c z WHERE x.i = y.i AND y.j = z.j")) == ["x", "y", "z", "xy", "yz", "xyz"]


def test_language(spark):
    """Every prefix of the reading form is a step of the conditional chain."""
    q = workload_queries._forms(spark, SF).where("pattern rlike '[^%_]'").select("pattern", L.steps(F.col("pattern")).alias("a"), P.conditional_steps(F.col("pattern")).alias("b"))
    assert q.count() > 0 and q.where("a is null or a <> b").count() == 0
    odd = spark.createDataFrame([("",), ("%",), ("%" + "_" * 40,), ("____a",), ("é%_____😀b",), ("a\nb%",)], "q string").select("q", L.encode(F.col("q")).alias("e"))
    assert [r["e"] is None for r in odd.collect()] == [True] + [False] * 5
    assert odd.where("e is not null").where(L.decode(F.col("e.form"), F.col("e.ends")) != F.col("q")).count() == 0


def test_drawn_workloads(spark):
    """Drawn patterns match a string at least; a second run draws the same; kinds keep to their shape."""
    s = queries.strings(spark, SF)
    got = {r["pattern"]: r["card"] for r in C.naive(s, W.general(s)).collect()}
    assert got and min(got.values()) >= 1 and {r["pattern"] for r in W.general(s).collect()} == set(got)
    assert any("_" in q for q in got) and any(not q.startswith("%") for q in got) and any(not q.endswith("%") for q in got)
    shaped = workload_queries.patterns_by_shape(spark, SF)
    assert shaped.where(P.shape(F.col("pattern")) != F.regexp_replace("shape", "w", "w")).count() == 0
    empty = spark.createDataFrame([], "s string, w long")
    for df in (W.general(empty), W.random_wildcards(empty), W.n_words(empty, 2), W.two_in_word(empty, 6), W.cut_long_words(empty, 6), W.word_counts(empty)):
        assert df.count() == 0
    assert W.split_sizes(100, 10**6) == {"train": 50, "valid": 5, "test": 5} and sum(W.split_sizes(100, 30).values()) == 29


def test_plan_features(spark):
    rows = workload_queries.plan_features(spark, SF).collect()
    kinds = [r["kind"] for r in rows]
    assert kinds.count("scan") == 2 and "aggregate" in kinds and {"hash_join", "merge_join"} & set(kinds)
    assert {r["relation"] for r in rows if r["kind"] == "scan"} == {"customer", "nation"}
    text = " ".join(t or "" for r in rows for t in r["terms"])
    assert "__LIKE__" in text or "OR" in text
    assert features.tree(["AND", "a", "OR", "b", "c", None, None]) == ("AND", ["a", ("OR", ["b", "c"])])
    assert features.normalised("a NOT LIKE 'x LIKE y' and b <> 1 and c IN (1, 2)") == "a __NOTLIKE__ 'x LIKE y' and b __NOTEQUAL__ 1 and c __ANY__ (1, 2)"
    root = features.plan(spark.range(5).where("id > 2"))
    assert [len(level) for level in features.levels(root)][0] == 1 and sum(1 for _ in features.preorder(root)) == sum(map(len, features.levels(root)))


def test_hybrid(spark):
    """Estimates keep to the bound, exact hits are the counts, and the model is better than the bound alone."""
    rows = workload_queries.hybrid_estimates(spark, SF).collect()
    assert rows and all(r["exact"] == r["true"] for r in rows if r["exact"] is not None) and all(r["est"] <= r["bound"] + 1e-9 for r in rows if r["exact"] is None)
    q = lambda t, e: max(max(t, 1) / max(e, 1), max(e, 1) / max(t, 1))
    assert sum(q(r["true"], r["est"]) for r in rows) < sum(q(r["true"], r["bound"]) for r in rows)


def test_ratio_for_size(spark):
    """The same number of keys as pruning itself leaves, and the next step of the ratio leaves too many."""
    table = S.ngram_table(queries.strings(spark, SF), 2)
    ratio, size = H.ratio_for_size(table, 150, 6)
    assert size <= 150 and S.prune_top(table, ratio).count() == size and S.prune_top(table, ratio + 2**-6).count() > 150


def test_pattern_vectors(spark):
    vectors = spark.createDataFrame([("c_ab", [1.0, 0.0]), ("c_a", [9.0, 9.0]), ("c_z", [0.0, 1.0])], "token string, vec array<double>")
    got = {r["pattern"]: (r["n_known"], r["vec"]) for r in H.pattern_vectors(spark.createDataFrame([("%abx%yz%",), ("%q%",), ("",)], "pattern string"), vectors, "c_").collect()}
    assert got == {"%abx%yz%": (2, [0.5, 0.5]), "%q%": (0, None), "": (0, None)}


def test_lbs(spark):
    """One part of at most a gram's length is exact (where it isn't anchored on both sides); no estimate is above its rarest part."""
    got = {r["pattern"]: r for r in workload_queries.lbs_estimates(spark, SF).collect()}
    cards = {r["pattern"]: r["card"] for r in C.naive(queries.strings(spark, SF), queries.patterns(spark, SF)).collect()}
    assert set(got) == set(cards) and all(r["est"] >= 0 for r in got.values())
    short = [q for q in got if got[q]["n_parts"] == 1 and (q.startswith("%") or q.endswith("%")) and len(q.strip("%")) <= 3]
    assert short and all(got[q]["est"] == cards[q] for q in short)
    assert got["%"]["est"] == sum(r["w"] for r in queries.strings(spark, SF).collect())


def test_more_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text('1,"a \\"b\\" c",\n2,x,y\n')
    assert [tuple(r) for r in files.escaped_csv(spark, str(tmp_path / "e.csv"), "i int, a string, b string").orderBy("i").collect()] == [(1, 'a "b" c', None), (2, "x", "y")]
    (tmp_path / "p.tbl").write_text("1|red bolt|\n2|x|\n")
    assert [tuple(r) for r in files.delimited(spark, str(tmp_path / "p.tbl"), "i int, a string").orderBy("i").collect()] == [(1, "red bolt"), (2, "x")]
    (tmp_path / "d.xml").write_text("<r><p><title>One</title></p><p><year>1</year></p></r>")
    assert sorted(r["s"] for r in files.xml_field(spark, str(tmp_path / "d.xml"), "p", "title").collect()) == ["", "One"]
    files.write_lines(spark.createDataFrame([("a",), (None,)], "x string").coalesce(1), "x", str(tmp_path / "lines"))
    assert sorted(r["s"] for r in files.lines(spark, str(tmp_path / "lines")).collect()) == ["", "a"]
    spark.range(1).createOrReplaceTempView("some_view")
    assert ("some_view", "id", "bigint") in [tuple(r) for r in files.catalog_columns(spark).collect()]


def test_cross_entropy(spark):
    r = spark.createDataFrame([(0.5, 1), (1.0, 0)], "p double, t int").select(S.cross_entropy(F.col("p"), F.col("t")).alias("x")).collect()
    assert math.isclose(r[0]["x"], math.log(2)) and math.isclose(r[1]["x"], -math.log(1e-7), rel_tol=1e-6)


def test_edge_words_of_all_documents(spark, tmp_path):
    """Against a plain count: accents, emoji, white space that only some engines know, null and empty texts."""
    texts = [None, "", " ", " \t\n", "é", " naïve café ", "a\x0bb", "\x0b", "a\u00a0b c", "a\u2003b", "日本 語\r\n", "\x1c x\x85", "😀 😀", "plain words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), SF):
        rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
        got = sorted(map(tuple, queries.QUERIES["edge_words"](spark, folder).collect()))
        plain = lambda t: len([w for w in t.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w])
        assert got == sorted((r["doc_id"], max(plain(r["text"] or ""), int(bool(r["text"])))) for r in rows)


def test_more_rows_than_a_broadcast_takes(spark, monkeypatch):
    """Wildcard-only patterns and shapes beyond the limits of a broadcast are counted too."""
    monkeypatch.setattr(C, "BROADCAST_ROWS", 2)
    strings = C.weighted(spark.createDataFrame([(s,) for s in CORPUS], "x string"), "x")
    got = {r["pattern"]: r["card"] for r in C.positional(strings, spark.createDataFrame([("_" * n,) for n in range(4, 11)], "pattern string")).collect()}
    assert got == {"_" * n: sum(len(s) == n for s in CORPUS) for n in range(4, 11)}
    word = "".join(chr(97 + i % 26) for i in range(1100))
    shapes = spark.createDataFrame([("%w%", 1, n) for n in range(1, 1101)], "shape string, low int, high int")
    got = W.by_shape(spark.createDataFrame([(word, 1)], "s string, w long"), shapes)
    assert {r["pattern"] for r in got.collect()} == {f"%{word[:n]}%" for n in range(1, 1101)}
