"""Engines, estimators, sources and plan readers against one another and against plain versions."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from globmill import engine_queries, queries, registry
from globmill.functions import patterns as P
from globmill.learned import models, tape
from globmill.operators import counting as C
from globmill.operators import engines as N
from globmill.operators import estimators as E
from globmill.operators import predicates as K
from globmill.operators import reports as R
from globmill.operators import statistics as S
from globmill.operators import workloads as W
from globmill.plans import explain, features, sqltext
from globmill.sources import files

SF = "/root/testdata/sf0.001"


def _like(s, q):
    return bool(re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q), s, re.S))


def _case(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abé\\ñ%_x😀"[: rng.randrange(2, 10)]) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    patterns = ["".join(rng.choice("ab%_é%x") for _ in range(rng.randrange(0, 7))) for _ in range(90)] + ["\\%", "%\\%", "a.b%", "%😀_"]
    strings = C.weighted(spark.createDataFrame([(t,) for t in [*texts, None]], "x string"), "x")
    want = {q: sum(_like(t, q) for t in [*texts, ""]) for q in patterns}
    return strings, spark.createDataFrame([(q,) for q in patterns], "pattern string"), want


@pytest.mark.parametrize("name", [*registry.ENGINES, "by_parts", "ordered201"])
def test_engines_agree_with_plain_matching(spark, name):
    engine = C.by_parts if name == "by_parts" else registry.engine(name)
    for seed in (1, 2):
        strings, patterns, want = _case(spark, seed)
        assert {r["pattern"]: r["card"] for r in engine(strings, patterns).collect()} == want
    nothing = strings.limit(0)
    assert {r["card"] for r in engine(nothing, patterns).collect()} == {0}


def test_narrow_with_partitions_that_match_nothing(spark):
    """Fewer strings than partitions, and strings that no pattern meets."""
    patterns = spark.createDataFrame([("a%",), ("%zz%",), ("__",)], "pattern string")
    for texts, want in ((["ab"], {"a%": 1, "%zz%": 0, "__": 1}), (["b"], {"a%": 0, "%zz%": 0, "__": 0})):
        strings = spark.createDataFrame([(t, 1) for t in texts], "s string, w long")
        assert {r["pattern"]: r["card"] for r in N.narrow(strings, patterns).collect()} == want


def test_large_sets_take_no_nested_loop(spark, monkeypatch):
    strings, patterns, want = _case(spark, 3)
    monkeypatch.setattr(C, "BROADCAST_BYTES", 10)
    for engine in (C.naive, N.narrow):
        df = engine(strings, patterns)
        assert {r["pattern"]: r["card"] for r in df.collect()} == want
    plan = C.by_parts(strings, patterns)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("rows", [0, 100_000])
def test_pairs_by_anchored_tokens(spark, monkeypatch, rows):
    """Broadcast patterns and salted joins give the same pairs; tokens in any order aren't held to their edges."""
    monkeypatch.setattr(C, "KEYED_ROWS", rows)
    for seed in (5, 6):
        strings, patterns, want = _case(spark, seed)
        for engine in (C.by_parts, N.ordered):
            assert {r["pattern"]: r["card"] for r in engine(strings, patterns).collect()} == want
        texts = [(r["s"], r["w"]) for r in strings.collect()]
        got = {r["pattern"]: r["n"] for r in R.all_tokens_occur(strings, patterns).collect()}
        assert got == {q: sum(w for s, w in texts if all(t in s for t in re.findall("[^%_]+", q))) for q in want}
    plan = C.by_parts(strings, patterns)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_positional_shuffles_no_lists(spark, monkeypatch):
    """Position lists and pairs stay where the strings are, also with patterns in several groups; overlapping places of a token count once."""
    texts = ["aaa", "aaab", "ababa", "xaéaé", "", "b"]
    patterns = ["%aa%", "%aa", "aa%", "%a_a%", "%a_%b", "_a%", "a%a", "%é%_", "aaa", "%a%a%a%", "_%a_%", "%a_a_a", "zz%", "%", "__"]
    strings, asked = spark.createDataFrame([(s, 1) for s in texts], "s string, w long"), spark.createDataFrame([(q,) for q in patterns], "pattern string")
    want = {q: sum(_like(s, q) for s in texts) for q in patterns}
    for rows in (100_000, 3):
        monkeypatch.setattr(C, "KEYED_ROWS", rows)
        df = C.positional(strings, asked)
        assert {r["pattern"]: r["card"] for r in df.collect()} == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "sid#" not in plan


def test_augmented_counts(spark):
    strings, patterns, _ = _case(spark, 4)
    texts = [(r["s"], r["w"]) for r in strings.collect()]
    both = {r["pattern"]: r["card"] for r in registry.counted("typed", strings, patterns, "both").collect()}
    forms = [r[0] for r in patterns.select(P.canonical(F.col("pattern"))).distinct().collect()]
    assert set(both) == {x for q in forms for i in range(1, len(q) + 1) for x in (q[:i], q[len(q) - i :])}
    assert all(n == sum(w for t, w in texts if _like(t, q)) for q, n in both.items())
    with pytest.raises(KeyError):
        registry.engine("no such")


def test_conditions(spark):
    """The places that conditions allow are those of the matches."""
    assert K.conditions_of("a_%bc__d") == [K.Condition("prefix", 1, False), K.Condition("substring", 2, True), K.Condition("substring", 4, False), K.Condition("suffix", 0, False)]
    assert K.conditions_of("%_") == []
    told = {(r["pattern"], r["i"]): (r["kind"], r["number"], r["open"]) for r in engine_queries.pattern_conditions(spark, SF).collect()}
    for q in {k for k, _ in told}:
        own = K.conditions_of(models.canonical(q, False))
        assert [told[q, i] for i in range(len(own))] == [(c.kind, c.number, c.open) for c in own]
    x = spark.createDataFrame([("xab", 2), ("ab", 1), ("abx", 1)], "s string, p int")
    suffix = K.Condition("suffix", 1, False).holds(F.col("p"), length=F.length("s"))
    assert [r[0] for r in x.select(suffix).collect()] == [True, True, False]


def test_predicates(spark):
    x = spark.createDataFrame([("a_b", 1), ("axb", None), (None, 3), ("50%", 4)], "s string, n int")
    test = lambda *t: [r[0] for r in x.select(K.test(x, *t)).collect()]
    assert test("s", "LIKE", "a_b") == [True, True, False, False] and test("s", "NOT LIKE", "a%") == [False, False, False, True]
    assert test("n", "IN", ["1", 4]) == [True, False, False, True] and test("n", "!=", 1) == [False, False, True, True] and test("n", "IN", []) == [False] * 4
    plain = [r[0] for r in x.select(F.coalesce(K.like_plain_underscore(F.col("s"), F.lit("a_%")), F.lit(False))).collect()]
    assert plain == [True, False, False, False]
    with pytest.raises(TypeError):
        K.test(x, "n", "LIKE", "1%")


PLAN = {"Node Type": "Hash Join", "Hash Cond": "(t.id = mc.movie_id)", "Total Cost": 10.5, "Plan Rows": 7, "Actual Rows": 9, "Plans": [
    {"Node Type": "Seq Scan", "Relation Name": "title", "Alias": "t", "Filter": "((title)::text ~~ '%a.b%'::text)", "Total Cost": 4, "Plan Rows": 20},
    {"Node Type": "Bitmap Heap Scan", "Relation Name": "movie_companies", "Alias": "mc", "Recheck Cond": "(mc.x <> 1)", "Total Cost": 3, "Plan Rows": 5, "Plans": [
        {"Node Type": "BitmapOr", "Total Cost": 1, "Plan Rows": 0, "Plans": [{"Node Type": "Bitmap Index Scan", "Index Name": "ix", "Index Cond": "(x = 2)", "Total Cost": 1, "Plan Rows": 5}]}]}]}


def test_explained_plans(spark):
    xml = "<explain xmlns='http://x'><Query><Plan><Node-Type>Seq Scan</Node-Type><Relation-Name>t</Relation-Name><Plan-Rows>3</Plan-Rows><Plans><Plan><Node-Type>Result</Node-Type></Plan></Plans></Plan></Query></explain>"
    rows = explain.rows(spark, {"a": json.dumps([{"Plan": PLAN}]), "b": xml}).orderBy("plan", "seq").collect()
    assert [r["kind"] for r in rows] == ["hash_join", "scan", "bitmap_heap_scan", "bitmap_or", "bitmap_index_scan", "scan", "result"]
    assert [r["parent"] for r in rows] == [None, 0, 0, 2, 3, None, 0] and rows[0]["terms"] == ["(title.id = movie_companies.movie_id)"] and rows[2]["terms"] == ["(movie_companies.x __NOTEQUAL__ 1)"]
    assert (rows[0]["cost"], rows[0]["rows"], rows[0]["actual"], rows[5]["rows"]) == (10.5, 7, 9, 3)
    got = explain.selectivities(spark, {"a": json.dumps([{"Plan": PLAN}])}, {"title": 100}).collect()
    assert [(r["table"], r["condition"], r["sel"]) for r in got] == [("title", "((title) LIKE '%a.b%')", 0.2)]
    spark.range(10).createOrReplaceTempView("ten")
    assert {"scan", "filter"} <= {r["kind"] for r in explain.explained(spark, {"q": "SELECT * FROM ten WHERE id > 3"}).collect()} | {"scan"}
    assert [t[:2] for t in explain.timed(lambda sql: spark.sql(sql).collect(), {"q": "SELECT 1"}, 2)] == [("q", 0), ("q", 1)]


def test_statistics_of_tables(spark):
    spark.sql("CREATE TABLE analysed USING parquet AS SELECT id, cast(id AS string) AS s FROM range(20)")
    explain.analyse(spark, ["analysed"])
    assert "20 rows" in spark.sql("DESCRIBE EXTENDED analysed").where("col_name = 'Statistics'").first()["data_type"]
    spark.sql("DROP TABLE analysed")


def test_query_texts():
    assert sqltext.translate("t.a = x.b AND t.c LIKE 't.d'", {"t": "title"}) == "title.a = x.b AND title.c LIKE 't.d'"
    where = "t.a LIKE '%x%' AND t.b = 1 AND t.a <> '' AND c LIKE 'it''s'"
    assert sqltext.conditions_on(where, {"t.a"}) == ["t.a LIKE '%x%'"] and sqltext.conditions_on(where, {"c", "t.b"}) == ["t.b = 1", "c LIKE 'it''s'"]
    sql = sqltext.hub("SELECT count(*) FROM posts p, votes v, badges b WHERE p.UserId = v.UserId AND v.UserId = b.UserId AND p.Score > 1", "users", "Id")
    tables, filters, joins = sqltext.split(sql)
    assert tables["hub"] == "users" and filters == ["p.Score > 1"] and {(a, b) for a, _, b, _ in joins} == {("p", "hub"), ("v", "hub"), ("b", "hub")}


def test_sampling_by_newton():
    for n, m, k in ((400, 100, 0), (4000, 200, 5), (4000, 200, 150), (60, 7, 1)):
        low, high = E.interval_smooth(n, m, k)
        a, b = E.interval(n, m, k)
        assert a - 1.5 <= low <= a + 1.5 and b - 1.5 <= high <= b + 1.5
    assert abs(E.stirling(10) - math.log(math.factorial(10))) < 1e-6 and abs(E.newton(lambda x: x * x - 2, 1.5, 0, 2) - math.sqrt(2)) < 1e-6


def test_drawn_triplets(spark):
    edges = S.transitions(queries.strings(spark, SF))
    rows = E.drawn_triplets(edges, 3).collect()
    near = {(r["node"], r["near"]) for r in E.steps(edges).collect()}
    assert rows and all((r["anchor"], r["positive"]) in near for r in rows) and {r["draw"] for r in rows} == {0, 1, 2}
    assert sorted(rows) == sorted(E.drawn_triplets(edges.repartition(5), 3).collect())
    total = E.steps(edges).groupBy("node").agg(F.sum("p").alias("p")).where(F.abs(F.col("p") - 1) > 1e-9).count()
    assert total == 0


def test_parity_by_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(6), float(rng.randrange(6))) for _ in range(60)]
    pairs = [((a < c) == (b < d)) for a, b in rows for c, d in rows if a != c]
    got = E.parity(spark.createDataFrame(rows, "true int, est double")).first()["parity"]
    assert abs(got - sum(pairs) / len(pairs)) < 1e-12
    assert E.parity(spark.createDataFrame([(1, 1.0)], "true int, est double")).first()["parity"] is None


def test_all_augmentations(spark):
    got = spark.createDataFrame([("%ab%",)], "q string").select(P.augmented(F.col("q")), P.delimiter(F.col("q"), True), P.wildcard_runs(F.lit("a_%b%c__"))).first()
    assert set(got[0]) >= {"%", "%a", "%ab", "%ab%", "%a%", "__%"} and got[1] == ["%", "%a%", "%ab%"] and got[2] == ["%", "_%", "__"]
    assert got[0] == sorted(set(got[0]))


def test_uniform_workload(spark):
    s = queries.strings(spark, SF)
    x = W.uniform(W.general_kinds(s), 100).collect()
    assert len({(r["kind"], r["n"], r["pattern"]) for r in x}) == len(x) and {r["split"] for r in x} <= {"train", "valid", "test"}
    assert all(not (r["split"] == "train" and list(map(tuple, x)).count(tuple(r)) > 1) for r in x)


def test_utf8(spark):
    x = spark.createDataFrame([(b"ab",), ("é".encode()[:1] + b"x",), ("日本".encode(),)], "b binary")
    assert [tuple(r) for r in x.select(files.valid_utf8("b"), files.readable("b"), files.readable("b", "null")).collect()] == [(True, "ab", "ab"), (False, "�x", None), (True, "日本", "日本")]


def test_sinks_and_caches(spark, tmp_path):
    labels = spark.createDataFrame([("%a%", 3), ("b%", 0)], "pattern string, card long")
    assert files.write_sqlite(labels, str(tmp_path / "l.db")) == 2 and sorted(files.sqlite(spark, str(tmp_path / "l.db")).collect()) == sorted(labels.collect())
    s = queries.strings(spark, SF)
    for least in (1, 20, 20):
        t = files.cached_ngrams(s, str(tmp_path / "cache"), 3, least)
        assert t.count() == S.ngram_table(s, 3).where(F.col("cnt") >= least).count()
    files.write_batches(labels.withColumn("k", F.col("card")), str(tmp_path / "b"), "pattern", 1)
    assert sum(files.batch(spark, str(tmp_path / "b"), n).count() for n in range(2)) == 2
    (tmp_path / "h.csv").write_text("Id,Name\n1,x\n2,\n")
    assert [tuple(r) for r in files.typed_tables(spark, str(tmp_path), {"h": "Id int, Name string"}, header=True)["h"].orderBy("Id").collect()] == [(1, "x"), (2, None)]
    files.write_sample_counts(spark.createDataFrame([("%a%", 4, 2.0, 10, 5, 1)], "query string, true long, est double, n long, m long, k long"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().asDict() == {"query": "%a%", "true": "4", "est": "2.0", "q-error": "2.0", "n": "10", "m": "5", "k": "1"}


def test_runs(spark, tmp_path):
    texts = [r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    (tmp_path / "s.txt").write_text("\n".join(texts) + "\n")
    (tmp_path / "p.txt").write_text("%bolt%\nred%\n_e%\n")
    registry.run_count(spark, "narrow", str(tmp_path / "s.txt"), str(tmp_path / "p.txt"), str(tmp_path / "out"), "prefix")
    got = dict(tuple(r) for r in spark.read.csv(str(tmp_path / "out/counts"), quote='"', escape='"').collect())
    assert got["red%"].split(" ") == ["0", "0", "0", str(sum(t.startswith("red") for t in texts))]
    assert spark.read.csv(str(tmp_path / "out/time"), header=True).first()["engine"] == "narrow"
    rows = [f"%{w}%,{sum(w in t for t in texts)}" for w in ("bolt", "red", "gear", "al", "te", "x")]
    (tmp_path / "l.csv").write_text("\n".join(rows) + "\n")
    settings = registry.Settings(grams=3).overridden({"part": {"sample": 50, "other": 1}}, "part")
    assert (settings.sample, settings.extra) == (50, {"other": 1})
    stats = registry.sweep(lambda k: registry.run_estimate(spark, "bound", str(tmp_path / "s.txt"), {"train": str(tmp_path / "l.csv"), "test": str(tmp_path / "l.csv")}, registry.result_path(str(tmp_path / "r"), "part", "w", "bound", k.grams), k), settings, grams=(2, 5))
    assert len(stats) == 2 and stats[1][1]["avg"] <= stats[0][1]["avg"] and set(stats[0][1]) >= {"q001", "q100", "model_size"}
    lines = [r["value"] for r in spark.read.text(registry.result_path(str(tmp_path / "r"), "part", "w", "bound", 2) + "/stat").collect()]
    assert any(x.startswith("q050: ") for x in lines)
    model = registry.estimator("sample_half", settings).fit(queries.strings(spark, SF))
    assert registry.latencies(model, queries.patterns(spark, SF), 2).count() == 2


def test_derivatives():
    rng = np.random.default_rng(0)
    p = tape.Parameters(1)
    for name, *shape in (("a", 4, 3), ("b", 3, 3), ("c", 3), ("d", 6, 2)):
        p.add(name, *shape)
    x, at = rng.normal(size=(5, 4)), np.array([0, 2, 2, 1])

    def loss(v):
        h = (tape.value(x) @ v["a"] + v["c"]).tanh()
        g = (h @ v["b"]).sigmoid() * h - (h * h).relu()
        e = tape.softmax(tape.stack([g, h], 1), 1).sum(1)
        both = tape.concat([e.take(at), (h.take(at)).max(1).reshape(4, 1) * np.ones((4, 3))], 1)
        return ((both @ v["d"]).exp() + 1.0).log().sum() + (h.sum(0) * h.sum(0) + 1.0).inverse().sum()

    own = p.opened()
    loss(own).backward()
    for k in p:
        for i in np.ndindex(*p[k].shape):
            keep, ends = p[k][i], []
            for step in (1e-6, -1e-6):
                p[k][i] = keep + step
                ends.append(float(loss(p.opened()).data))
            p[k][i] = keep
            assert abs((ends[0] - ends[1]) / 2e-6 - own[k].grad[i]) < 1e-4, (k, i)


@pytest.mark.parametrize("name", sorted(models.MODELS))
def test_learned_estimators(spark, name):
    """Every pattern gets an estimate within the table; training lowers the loss, and the estimates beat one constant."""
    s, p = queries.strings(spark, SF), queries.patterns(spark, SF)
    cards = C.naive(s, p)
    n = s.agg(F.sum("w")).first()[0]
    model = registry.estimator(name).fit(s, cards)
    got = {r["pattern"]: r["est"] for r in model.estimate(p).collect()}
    true = {r["pattern"]: r["card"] for r in cards.collect()}
    assert set(got) == set(true) and all(0 <= e <= n + 1e-6 for e in got.values())
    assert model.told[-1] < model.told[0] and model.size() > 0
    q = lambda t, e: max(max(t, 1) / max(e, 1), max(e, 1) / max(t, 1))
    middle = math.expm1(np.mean(np.log1p(list(true.values()))))
    assert np.mean([math.log(q(true[k], got[k])) for k in true]) < np.mean([math.log(q(t, middle)) for t in true.values()])
    again = registry.estimator(name).fit(s, cards).estimate(p)
    assert {r["pattern"]: r["est"] for r in again.collect()} == pytest.approx(got)


def test_plan_trees(spark):
    plans = [spark.range(k).where(f"id > {k % 3}") if k % 2 else spark.range(k).groupBy((F.col("id") % 3).alias("g")).count() for k in range(2, 22)]
    levels = [features.levels(features.plan(x)) for x in plans]
    goals = [[1.0, 0.0] if k % 2 else [0.0, 1.0] for k in range(2, 22)]
    net = models.PlanTree(len(features.KINDS) + 1)
    told = net.fit(levels, goals)
    assert told[-1] < 0.05 < told[0] and abs(net.predict(levels[0]) - goals[0]).max() < 0.5


def test_token_parts(spark):
    one = models.Embedded()
    got = {}
    for r in R.typed_parts(queries.patterns(spark, SF)).orderBy("i").collect():
        got.setdefault(r["pattern"], []).append((r["part"], models.Embedded.KINDS.index(r["kind"])))
    assert all(one.parts(q) == v for q, v in got.items())
    c = queries.patterns(spark, SF).select("pattern", P.canonical(F.col("pattern"), True).alias("c"), P.canonical(F.col("pattern")).alias("d")).collect()
    assert all(models.canonical(r["pattern"]) == r["c"] and models.canonical(r["pattern"], False) == r["d"] for r in c)
