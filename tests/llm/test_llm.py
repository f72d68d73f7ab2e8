"""Small tests: brute force, round trips, held-out accuracy, and the cases that each operator defines."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from globmill.llm import _common, bpe, covertree, langid, licenses, minhash, mixing, mpegts, packing, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
CLASHING = ("id", "key", "size", "position", "epoch", "ids", "media", "class", "component", "w", "s", "p", "n", "band", "nth", "target", "start", "times", "toxic", "h", "_x")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` string" for k in CLASHING)
UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """documents, labels and embeddings with nulls, empty and very long texts, ties, repeats and clashing extra columns."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "éclair", "naïve", "42", "x@y.org", "the", "of"]
    texts = [None, "", "   \t\n", "one", "ONE", "one two", "!!! ... ???", "é", "<|endoftext|> it's", "word " * 30_000, "a" * 60_000]
    long = " ".join(rng.choice(words) for _ in range(400))
    texts += [long, long, long.replace("gamma", "GAMMA"), long + " tail", "+1 (743) 555-3824 and 4242424242424242 at a.b@c.de from 10.0.0.1", "MIT license, mit  License; cc by-nc 4.0", "4465758382889437 4465758382889437"]
    pairs = [*enumerate(texts), (3, texts[3]), (11, long), (5, "another text of document 5"), (None, long), (None, "nobody's text"), (None, None)]
    rows = [(i, t, None if i is None or i % 5 == 0 else "en", None if i is None or i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), *(["k"] * (len(CLASHING) - 1)), None) for i, t in pairs]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, i % 2) for i in range(len(texts))] + [(None, 1, 1), (2, None, None), (3, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.1], [0.0, 1.0], [1e30, 0.0], [1.0]]
    vectors = [*enumerate(vectors), (6, vectors[6]), (7, None), (0, None), (None, [1.0, 0.0])]
    spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], "vec_id long, embedding array<float>, id int, class string, w int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", [*queries.MODULES, "pipeline"])
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).collect() == []


def _rows(spark, folder):
    return sorted(((r["doc_id"], r["text"]) for r in _docs(spark, folder).select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name", queries.MODULES)
def test_odd_rows(spark, odd, name):
    """Every row comes back, whatever its id; vectors once for each vec_id."""
    got = queries.queries()[name](spark, odd).collect()
    if name == "op9_packing":
        assert Counter(d for r in got for d, at in zip(r["doc_ids"], r["offsets"], strict=True) if at == 0) == Counter(i for i, _ in _rows(spark, odd))
    elif name == "op3_covertree":
        assert sorted(r[0] for r in got) == list(range(13))
    else:
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in _rows(spark, odd))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, odd, name):
    for folder in (odd, SF):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet{'/*.parquet' if folder == odd else ''}')")
        want, got = con.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, folder).toPandas()
        by = sorted(want.columns)
        assert by == sorted(got.columns)
        want, got = (x.sort_values(by).reset_index(drop=True) for x in (want, got))
        for k in want.columns:
            assert all(pd.isna(a) and pd.isna(b) or bool(pd.notna(a) and pd.notna(b) and a == b) for a, b in zip(got[k], want[k], strict=True)), k


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_bpe_equals_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(bpe.NAME))
    for folder in (odd, SF):
        want = Counter()
        for i, t in _rows(spark, folder):
            ids = lib.encode(t or "", add_special_tokens=False).ids
            decoded = lib.decode(ids, skip_special_tokens=False)
            want[i, len(ids), _sha(np.array(ids, "<u4").tobytes()), _sha(decoded.encode())] += 1
        got = bpe.op1_bpe(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        assert Counter(map(tuple, got.collect())) == want


def _sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_speculation():
    """Verified proposals are the exact merges, and a proposal that is rejected isn't."""
    import public_tokenizers

    with open(public_tokenizers.path(bpe.NAME), "rb") as f:
        e = bpe.WordBpe(f.read())
    rng = random.Random(5)
    words = ["".join(rng.choice("abdehilnorst") for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + ["aaaa", "aaaaa", "a" * 999]
    for w, got in zip(words, e.words(words), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.exact(w)
    failing = [w for w in words if e.propose(w) != e.exact(w)]
    assert e.counts[1] == len(failing) < len(words)


def _mixed(rows, weights=(5, 2, 1), most=3, ties=None):
    """(doc_id, text, source) -> (times, position of the first copy) by plain loops: water-filled targets, streams by md5, one token clock."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if most * total[s] <= level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
            free.discard(s)
    if not free and names:
        target = {s: target.get(s, most * total[s]) for s in names}
    reach = lambda k, t: [1.5 * t - t * t / 2 if t <= 0.5 else 0.625 + (t - 0.5) - (t - 0.5) ** 2 / 2, t, 0.5 * t + t * t / 2 if t <= 0.5 else 0.375 + (t - 0.5) + (t - 0.5) ** 2 / 2][k % 3]

    def time(k, share):
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if reach(k, mid) < share else (low, mid)
        return high

    out = [None] * len(rows)
    for k, s in enumerate(names):
        at = 0
        own = sorted((i for i in range(len(rows)) if rows[i][2] == s), key=lambda i: (hashlib.md5(str("" if rows[i][0] is None else rows[i][0]).encode()).hexdigest(), ties[i] if ties else (rows[i][0] is not None, rows[i][0] or 0), size[i]))
        for i in own:
            times = sum(size[i] > 0 and at + size[i] / 2 + e * total[s] < target[s] for e in range(most))
            t = time(k, min(1.0, at / target[s])) if times else None
            out[i] = (times, None if t is None else sum(target[x] * reach(j, t) for j, x in enumerate(names)))
            at += size[i]
    return out, size, target


def test_mixing_by_plain_loops(spark, odd):
    for folder in (odd, SF):
        rows = sorted(((r["doc_id"], r["text"], r["source"]) for r in _docs(spark, folder).collect()), key=str)
        plain, size, target = _mixed(rows)
        got = sorted(((r["doc_id"], r["size"], r["taken"], r["position"]) for r in mixing.op2_mixing(spark, folder).collect()), key=str)
        want = sorted(((r[0], n, times * n, at) for r, n, (times, at) in zip(rows, size, plain, strict=True)), key=str)
        key = lambda r: (str(r[0]), r[1], r[2], r[3] or -1)
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 0.01)


def test_mixing_targets_and_order(spark, odd):
    docs = _docs(spark, SF)
    p = mixing.plan(docs).toPandas()
    by = p.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"), largest=("size", "max"))
    assert abs(by["target"].sum() - by["size"].sum()) < 1e-6 * by["size"].sum()
    assert (abs(by["taken"] - by["target"]) <= by["largest"] / 2 + 1).all() and (by["target"] <= 3 * by["size"] + 1e-6).all()
    again = mixing.plan(docs.repartition(7)).toPandas().set_index("key").loc[p["key"]].reset_index()
    assert all(p[k].equals(again[k]) for k in p.columns if k != "demands")
    got = mixing.curriculum(docs)
    assert got.columns == docs.columns and got.count() == int(p["times"].sum())
    at = mixing.positions(mixing.plan(docs)).toPandas()
    assert at["position"].between(0, p["target"].groupby(p["source"]).first().sum() + 1).all()
    heavy, light = (at[at["nth"] % 3 == k]["position"].mean() for k in (0, 2))
    assert heavy < light  # the first schedule fades, the third grows
    first = [r["position"] for r in mixing.op2_mixing(spark, SF).collect()]
    placed = [x for x in first if x is not None]
    assert placed == sorted(placed) and first[len(placed) :] == [None] * (len(first) - len(placed))
    strange = _docs(spark, odd)
    assert mixing.curriculum(strange).columns == strange.columns


def _links(sets, same):
    n = len(sets)
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    count = [0] * n
    for i in range(n):
        for j in range(i):
            if same(sets[i], sets[j]):
                count[i] += 1
                count[j] += 1
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return count, [find(i) for i in range(n)]


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_brute_force(spark, odd, n):
    for folder in (odd, SF):
        assert Counter(map(tuple, minhash.near_duplicates(_docs(spark, folder), n=n).collect())) == _groups(_rows(spark, folder), n)


def _shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def _near(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def _groups(rows, n):
    """(key, n_shingles, component_id, kept) of every row by comparing all pairs of keys."""
    keys = sorted({i for i, _ in rows if i is not None})
    sets = {i: [x for j, t in rows if i == j and (x := _shingles(t, n))] for i in keys}
    _, parts = _links([sets[i] for i in keys], lambda a, b: any(_near(x, y) for x in a for y in b))
    part = {i: keys[p] for i, p in zip(keys, parts, strict=True)}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
    out = Counter()
    for i, t in rows:
        own = part.get(i)
        if i is None and words(t):
            own = part.get(min((j for j, u in rows if j is not None and words(u) == words(t)), default=None))
        out[i, len(_shingles(t, n)), own, i == own] += 1
    return out


def test_minhash_mixed_buckets(spark, monkeypatch):
    """A chain of near copies whose ends are apart, in blocks of a few rows."""
    monkeypatch.setattr(minhash, "STRAYS", 2)
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[k * 3 :] + [f"n{j}" for j in range(k * 3)])) for k in range(30)] + [(99, "quite another text")]
    got = {r["key"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=1).collect()}
    assert got == {k: 0 for k in range(30)} | {99: 99}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    near = {frozenset(e) for e in edges}
    _, parts = _links(nodes, lambda a, b: frozenset((a, b)) in near)
    got = {r["node"]: r["component"] for r in _common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: nodes[p] for x, p in zip(nodes, parts, strict=True)}


@pytest.mark.parametrize("block", [40, 8192])
def test_covertree_brute_force(spark, odd, block):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    x = np.concatenate([centre, centre[:5].repeat(12, 0) + rng.normal(size=(60, 16)) * 0.2, centre[:3].repeat(4, 0), centre[3:6] * 2.5])
    for folder, rows in ((None, x.tolist()), (odd, None)):
        df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>") if rows else spark.read.parquet(f"{folder}/embeddings.parquet")
        told = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] is not None]
        # in the odd table, an id has one usable vector at most (but for repeats of it)
        vectors = [next((v for j, v in told if j == i and v), None) for i in sorted({i for i, _ in told})]
        width = max(len(v or ()) for v in vectors)
        good = [np.array(list(v) + [0.0] * (width - len(v))) if v and all(z is not None and np.isfinite(z) for z in v) and any(v) else None for v in vectors]
        cos = lambda a, b: a is not None and b is not None and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
        count, parts = _links(good, cos)
        report = {}
        got = sorted(covertree.near_duplicates(df, block=block, report=report).collect())
        assert report.get("checked", 0) <= report.get("dealt", 0) <= report.get("met", 0)
        assert [(r["key"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [(i, n, p, i == p) for i, (n, p) in enumerate(zip(count, parts, strict=True))]


def test_langid(spark, odd):
    docs = _docs(spark, "/root/testdata/sf0.01")
    got = langid.op4_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and lang is not null")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count() > 0
    odd_rows = {r["doc_id"]: r for r in langid.op4_langid(spark, odd).collect()}
    assert {r["doc_id"]: r["held_out"] for r in langid.op4_langid(spark, SF).collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in _rows(spark, SF)}
    assert all(odd_rows[i]["lang_pred"] == "und" and odd_rows[i]["score"] == 0 for i in (0, 1, 2, 6))
    assert odd_rows[3]["lang_pred"] == "en"


def _plain_grams(text):
    """N-grams of letters in lower case, one blank for each run of others and at both ends, by plain loops."""
    out, x = [], " "
    for ch in text or "":
        low = ch.lower() if len(ch.lower()) == 1 else ch
        if ch.isalpha():
            x += low
        elif x[-1] != " ":
            x += " "
    x = x if x[-1] == " " else x + " "
    for n in langid.SIZES:
        out += [g for i in range(len(x) - n + 1) if (g := x[i : i + n]).strip()]
    return out


def test_langid_against_exact_sets():
    """Bloom filters against sets of strings: no gram is lost, corrected counts are near, decisions are the same."""
    rows = duckdb.sql("select text, lang from '/root/testdata/sf0.01/documents.parquet' where text is not null and lang is not null order by doc_id").fetchall()
    learn, test = rows[:400], [t for t, _ in rows[400:700]] + ["", "42", "ÉÀ", "a" * 5000]
    sets = {k: {g for g, n in Counter(g for t, own in learn if own == k for g in _plain_grams(t)).items() if n >= 3} for k in {own for _, own in learn}}
    number = lambda g: int(langid.hashes(np.array([0 if ch == " " else ord(ch) for ch in g], np.uint32), len(g))[0])
    f = langid.Filters.build({k: np.array(sorted(number(g) for g in own), np.uint64) for k, own in sets.items()})
    total, claimed = f.counts(test)
    for t, all_, row, told in zip(test, total, claimed, f.predict(test)[0], strict=True):
        grams = _plain_grams(t)
        exact = np.array([sum(g in sets[k] for g in grams) for k in f.languages])
        assert all_ == len(grams) and (row >= exact).all()
        free = (row - all_ * f.false) / (1 - f.false)
        assert (abs(free - exact) <= 6 * np.sqrt(all_ * f.false * (1 - f.false)) + 0.05 * all_ + 1).all()
        order = np.sort(exact)
        if not grams:
            assert told == "und"
        elif order[-1] - order[-2] > 0.1 * len(grams):
            assert told == f.languages[exact.argmax()]


def test_langid_bit_sliced_counts():
    texts = ["the cat sat", "le chat noir", ""]
    held = {k: np.unique(np.concatenate([h for h, _ in langid._grams([t])])) for k, t in (("en", texts[0]), ("fr", texts[1]))}
    f = langid.Filters.build(held)
    total, claimed = f.counts(texts)
    assert total[2] == 0 and claimed[0, 0] == total[0] and claimed[1, 1] == total[1]  # no false negatives
    assert f.predict(texts)[0] == ["en", "fr", "und"]


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    vocab = {f"w{i}": i + 1 for i in range(6)}
    net = toxicity.Network(vocab, np.zeros(7))
    words = [*vocab, "other"]
    buckets, ends = net.spell(words)
    ids = np.array([vocab.get(w, 0) for w in words])
    place = rng.integers(0, len(words), (4, 5))
    mask = np.ones((4, 5), bool)
    mask[0, 3:] = False
    t = np.array([1.0, 0, 1, 0])

    def loss():
        logit, kept = net.forward(net.project(net.inputs(ids, buckets, ends))[place], mask, True)
        return float((np.logaddexp(0, logit) - t * logit).sum()), logit, kept

    _, logit, kept = loss()
    g = net.backward(toxicity._sigmoid(logit) - t, kept, net.inputs(ids, buckets, ends), place, ids, buckets, ends)
    for name, p in net.p.items():
        flat, grad = p.reshape(-1), g[name].reshape(-1)
        for k in rng.choice(np.nonzero(grad)[0], 3):
            flat[k] += 1e-5
            up = loss()[0]
            flat[k] -= 2e-5
            down = loss()[0]
            flat[k] += 1e-5
            assert abs((up - down) / 2e-5 - grad[k]) < 1e-4 * max(1, abs(grad[k])), name


def _plain_logits(net, text):
    """Logits of all windows by loops over words and units, from the formulas."""
    p, h, out = net.p, toxicity.HIDDEN, []
    sig = lambda x: 1 / (1 + math.exp(-x))
    words = toxicity.words_of(text.lower())
    x = []
    for w in words:
        raw = f"^{w}$".encode()
        own = [zlib.crc32(raw[i : i + 3]) % toxicity.BUCKETS for i in range(max(1, len(raw) - 2))]
        x.append([p["ew"][net.vocab.get(w, 0)][k] + sum(p["ec"][b][k] for b in own) / len(own) for k in range(toxicity.DIM)])
    for a in toxicity.windows(len(words)):
        own, states = x[a : a + toxicity.WINDOW], []
        for side in "fb":
            state, trail = [0.0] * h, []
            for v in own if side == "f" else own[::-1]:
                i = [sum(v[k] * p[f"w{side}"][k][j] for k in range(toxicity.DIM)) + p[f"x{side}"][j] for j in range(3 * h)]
                r = [sum(state[k] * p[f"u{side}"][k][j] for k in range(h)) + p[f"c{side}"][j] for j in range(3 * h)]
                z, reset = [sig(i[j] + r[j]) for j in range(h)], [sig(i[h + j] + r[h + j]) for j in range(h)]
                new = [math.tanh(i[2 * h + j] + reset[j] * r[2 * h + j]) for j in range(h)]
                state = [new[j] + z[j] * (state[j] - new[j]) for j in range(h)]
                trail.append(state)
            states.append(trail if side == "f" else trail[::-1])
        both = [f + b for f, b in zip(*states, strict=True)]
        e = [sum(math.tanh(sum(s[k] * p["wa"][k][j] for k in range(2 * h)) + p["ba"][j]) * p["va"][j] for j in range(toxicity.ATTENTION)) for s in both]
        weight = [math.exp(y - max(e)) for y in e]
        pool = [sum(w * s[k] for w, s in zip(weight, both, strict=True)) / sum(weight) for k in range(2 * h)]
        out.append(sum(pool[k] * p["wo"][k] for k in range(2 * h)) + p["bo"][0])
    return out


def test_toxicity_forward_by_plain_loops():
    rows = duckdb.sql("select text, toxic from '/root/testdata/sf0.1/documents.parquet' d join '/root/testdata/sf0.1/labels.parquet' l using (doc_id) where length(text) < 3000 order by doc_id limit 300").fetchall()
    net = toxicity.train([t for t, _ in rows], [int(y) for _, y in rows], epochs=2)
    texts = [*(t for t, _ in rows[:6]), "one", "two words", " ".join(f"w{i}" for i in range(33)), "", None, " ".join(f"x{i % 40}" for i in range(90))]
    got, (a, b) = net.scorer().logits(texts), net.scale
    for t, x, score in zip(texts, got, net.scorer().scores(texts), strict=True):
        want = _plain_logits(net, t) if t else []
        assert len(x) == len(want) and np.allclose(x, want, atol=1e-4)
        assert abs(score - (1 / (1 + math.exp(-(a * max(want) + b))) if want else 0.0)) < 1e-4
    few = toxicity.AT_ONCE
    try:
        toxicity.AT_ONCE = 3  # lots of a few windows change nothing
        assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(got, net.scorer().logits(texts), strict=True))
    finally:
        toxicity.AT_ONCE = few


def test_training_samples_are_bounded(spark, monkeypatch):
    """The sample never vanishes, keeps to its bounds, and is the same in every run and partitioning."""
    x = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("g"), F.concat(F.lit("text "), F.col("id") % 2500).alias("text"))
    for bound in (1, 40, 10_000):
        got = [sorted(map(tuple, _common.sampled(y, ["doc_id"], bound, "g").collect())) for y in (x, x.repartition(7))]
        assert got[0] == got[1] and all(n == min(bound, 1667 - (g == 2)) for g, n in Counter(r[1] for r in got[0]).items()) and len({r[1] for r in got[0]}) == 3
    assert _common.sampled(x, ["text"], 10_000).count() == 2500 and _common.sampled(x.limit(0), ["text"], 5).count() == 0
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = toxicity.training_sample(x, labels, bound=100, chars=600)
    assert 0 < len(rows) <= 200 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    assert all(sum(len(r["text"]) for r in rows if r["toxic"] == k) <= 600 for k in (0, 1)) and {r["toxic"] for r in rows} == {0, 1}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = _docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    net = toxicity.learned(docs, labels, bound=500)
    rows = docs.join(labels, "doc_id").where(_common.crc_mod(_common.F.col("doc_id"), 5) == 0).select("text", "toxic").collect()
    y = np.array([r["toxic"] for r in rows])
    s = np.array([x for i in range(0, len(rows), 200) for x in net.scorer().scores([r["text"] for r in rows[i : i + 200]])])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9
    assert net.scorer().scores([None, "", "...", "an idiot and a moron"])[:3] == [0.0, 0.0, 0.0]
    assert toxicity.train(["a", "b"], [0, 0]) is None


def test_toxicity_training_memory():
    """Training holds numbers of words, not their inputs or windows: the driver has little room beside the JVM."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'bad' if i % 2 else 'good'}{n}" for n in rng.integers(0, 10**6, 2000)) for i in range(60)]
    tracemalloc.start()
    net = toxicity.train(texts, [i % 2 for i in range(60)], epochs=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert net is not None and most < 50e6


def test_toxicity_training_in_lots(monkeypatch):
    """The size of the lots changes nothing; texts without words are not learned from."""
    texts = [" ".join(f"{'bad' if i % 3 else 'good'}{n % 50}" for n in range(i, i + 1 + 9 * (i % 12))) for i in range(40)]
    labels = [int(i % 3 > 0) for i in range(40)]
    texts[:4] = [None, "", "...", "- -"]
    want = toxicity.train(texts, labels, epochs=3)
    for name, few in (("LOT_TRAINING", 5), ("AT_ONCE_TRAINING", 3), ("WORDS_AT_ONCE", 7)):
        monkeypatch.setattr(toxicity, name, few)
    got = toxicity.train(texts, labels, epochs=3)
    assert got.vocab == want.vocab and all(np.allclose(got.p[k], want.p[k], atol=1e-6) for k in want.p) and np.allclose(got.scale, want.scale, atol=1e-4)
    assert toxicity.train([None, "", "...", "- -"] * 5, [0, 1, 0, 1] * 5) is None


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 57, 200, 1001):
        at = toxicity.windows(n)
        assert {i for a in at for i in range(a, a + toxicity.WINDOW)} >= set(range(n)) and all(a + toxicity.WINDOW <= max(n, toxicity.WINDOW) for a in at)


def test_transport_stream_faults():
    rng = random.Random(4)
    for size in (0, 1, 64, 150, 162, 163, 176, 183, 184, 185, 64_000, 64_001, 300_000):
        data = rng.randbytes(size)
        media = mpegts.write_stream(data)
        s = mpegts.read_stream(media)
        assert len(media) % 188 == 0 and s.payload == {mpegts.DATA_PID: data} and (s.gaps, s.repeats, s.bad_sections, s.cut) == (0, 0, 0, 0)
        assert s.programs == {1: mpegts.PMT_PID} and s.stamps[mpegts.DATA_PID] == [k * mpegts.TICKS for k in range(max(1, -(-size // 64_000)))]
        assert len(s.access[mpegts.DATA_PID]) == len(s.stamps[mpegts.DATA_PID])
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert mpegts.read_stream(b"".join(packets[:9] + packets[8:])).repeats == 1
    assert mpegts.read_stream(b"".join(packets[:9] + packets[8:])).payload[mpegts.DATA_PID] == data
    lost = mpegts.read_stream(b"".join(packets[:9] + packets[10:]))
    assert lost.gaps == 1 and lost.cut == 1
    assert mpegts.read_stream(bytes([media[0]]) + media[1:20] + b"x" + media[21:]).bad_sections >= 1
    assert mpegts.read_stream(b"").payload == {} and mpegts.read_stream(b"abc").cut == 3
    assert mpegts._stamp(0x1FFFFFFFF) == b"\x2f\xff\xff\xff\xff"


def test_media_query(spark, odd):
    for folder in (odd, SF):
        want = Counter()
        for i, t in _rows(spark, folder):
            raw = (t or "").encode()
            whole = raw + b"\0" * (64 if not raw else -len(raw) % 64)
            media = mpegts.write_stream(whole)
            want[i, len(raw), len(whole), _sha(whole), zlib.crc32(whole[-64:]), len(media), _sha(media)] += 1
        got = mpegts.op6_media(spark, folder).collect()
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
        assert Counter(tuple(r[k] for k in names) for r in got) == want
        assert all([p["pts"] for p in r["access_points"]] == [k * mpegts.TICKS for k in range(len(r["access_points"]))] and r["access_points"] for r in got)


def test_license_places(spark):
    docs = spark.createDataFrame([(1, "MIT license MIT license. cc-by, GNU General Public License, version 3 cc bY"), (2, "apache  LicenseK gnu general license"), (3, None)], "doc_id long, text string")
    docs.createOrReplaceTempView("x")
    got = {(r["key"], r["label"], r["start"]) for r in licenses.spans(docs).where("base").collect()}
    assert got == {(1, "mit", 0), (1, "mit", 2), (1, "cc-by", 4), (1, "gpl", 6), (1, "cc-by", 12)}
    assert "Python" not in licenses.spans(docs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("length", [16, 2048])
def test_packing_round_trip(spark, odd, length):
    import public_tokenizers

    vocab = packing.vocabulary(spark)
    for folder in (odd, SF):
        docs = _docs(spark, folder)
        packs = packing.pack(docs, vocab, length=length, group=64)
        rows = packs.collect()
        assert all(len(r["ids"]) == len(r["positions"]) == 2 * length and r["cu_seqlens"][-1] == r["n_tokens"] <= length for r in rows)
        r = max(rows, key=lambda r: r["n_segments"])
        at = np.frombuffer(r["positions"], "<u2")
        assert all(at[a:b].tolist() == list(range(b - a)) for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False))
        assert len({r["pack_id"] for r in rows}) == len(rows)
        want = Counter((i, t or "") for i, t in _rows(spark, folder))
        with open(public_tokenizers.path(packing.NAME), "rb") as f:
            own = packing._opened(f.read())
        got = Counter((r["doc_id"], own.decode(np.frombuffer(r["ids"], "<u2").tolist())) for r in packing.unpack(packs).collect())
        assert got == want
    for bad in ({"length": 1 << 17}, {"end": 1 << 16}):
        with pytest.raises(ValueError):
            packing.pack(docs, vocab, **bad)


def test_best_fit():
    rng = random.Random(6)
    sizes = [rng.randrange(1, 101) for _ in range(400)]
    bins, rooms = packing.best_fit_decreasing(sizes, 100), []
    for s in sorted(sizes, reverse=True):  # plain best fit
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(100 - s)
    assert sorted(100 - sum(sizes[i] for i in b) for b in bins) == sorted(rooms) and sorted(i for b in bins for i in b) == list(range(400))


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([ -]?[0-9])+",
    r"\+[0-9][ ().0-9-]+[0-9]",
]


def _base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, max(map(int, m[0].split("."))) <= 255 if k == 1 else True, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_patterns():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice("a.@@-+%0123456789 ()\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == _base(text), text
    for text in ("a@b.c@d.e", "1.2.3.4.5.6.7.8", "300.1.1.1", "000255.1.1.1", "4242 4242-4242 4242", "+1 (743) 555-3824)", "a" * 50_000 + "@", "1" * 50_000, "+" + "1" * 20):
        assert pii.base_spans(text) == _base(text)


def test_pii_query(spark, odd):
    """Every column that the contract names, against its patterns."""
    for folder in (odd, SF):
        want = Counter()
        for i, t in _rows(spark, folder):
            base = _base(t or "")
            told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
            want[(i, *(sum(k == j for _, k, _ in base) for j in range(4)), _sha(told.encode()))] += 1
        got = pii.op10_pii(spark, folder).collect()
        assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
        texts = Counter((i, len(_base(t or ""))) for i, t in _rows(spark, folder))
        assert sum(texts.values()) == len(got) and all(len([x for x in r["spans"].split(",") if x]) >= sum(r[1:5]) for r in got)
    assert any(len({r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]}) > 1 for r in got)


def test_pii_long_regions(monkeypatch):
    """Stretches change nothing, and spans near a region are found in step with it."""
    weights = np.random.default_rng(1).normal(size=(4, pii.FEATURES))
    rng = random.Random(3)
    texts = ["".join(rng.choice("12 .@a+-") for _ in range(300)) for _ in range(20)] + ["12 34 5 a@b.cc +1 (743) 555-3824 10.0.0.1 " * 20]
    whole = [pii.find(t, weights) for t in texts]
    monkeypatch.setattr(pii, "STRETCH", 3)
    assert [pii.find(t, weights) for t in texts] == whole
    for t, (base, spans) in zip(texts, whole, strict=True):
        more = sorted(set(spans) - set(base))
        assert set(base) <= set(spans) and not any(a[0] < b[2] and b[0] < a[2] for a in more for b in base)
        assert all(a[2] <= b[0] for a, b in zip(more, more[1:], strict=False))


def test_pii_field():
    """The sums run over all segmentations, the best one is the best of them, and the field finds joined numbers."""
    text = "x1 2@3"
    r = pii.Region(text, 0, len(text))
    w = np.random.default_rng(0).normal(size=(4, pii.FEATURES))
    scores = r.x @ w.T
    every = []

    def extend(at, total, path):
        if at == r.n:
            every.append((total, path))
            return
        extend(at + 1, total, path)
        for k, i in enumerate(r.first):
            if i == at:
                for kind in range(4):
                    extend(r.after[k], total + scores[k, kind], [*path, (r.cuts[i], kind, r.cuts[r.after[k]])])

    extend(0, 0.0, [])
    whole = np.logaddexp.reduce([t for t, _ in every])
    assert abs(pii.forward(r, scores)[-1] - whole) < 1e-9 and abs(pii.backward(r, scores)[0] - whole) < 1e-9
    assert pii.best(r, w) == max(every)[1]
    rows = duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet' where regexp_matches(text, '[0-9@]') order by doc_id limit 500").fetchall()
    weights = pii.train([t for (t,) in rows[:350]])
    held = [t for (t,) in rows[350:]]
    base, own = ({(i, *s) for i, t in enumerate(held) for s in f(t)} for f in (pii.base_spans, lambda t: [s for a, b in pii.regions(t) for s in pii.best(pii.Region(t, a, b), weights)]))
    assert len(base & own) >= 0.95 * len(base) and len(own - base) <= 0.1 * len(base)
    assert {s[1:] for s in pii.find("see 4465758382889437 4465758382889437 now", weights)[1]} == {(2, 20), (2, 37)}
    assert pii.replace("mail a@b.cc now", pii.base_spans("mail a@b.cc now")) == "mail <EMAIL> now"


def _same(df, rows):
    return spark_rows(df.collect()) == spark_rows(rows)


def spark_rows(rows):
    return Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows)


def test_pipeline(spark, odd):
    """Each stage against a plain version of what it has to do with its own input."""
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(bpe.NAME))
    for folder in (odd, SF):
        docs, last = _docs(spark, folder), None
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out, before = stage(spark, docs, folder), docs.collect()
            at = lambda r, k: r[names.index(k)]
            if name == "toxicity":
                net = toxicity.learned(docs, _common.table(spark, folder, "labels"))
                own = net.scorer() if net else None
                assert _same(out, [r for r in before if own is None or own.scores([r["text"]])[0] < 0.5])
            elif name == "near_duplicates":
                rows = list({tuple(r) for r in before})
                sets = [_shingles(at(r, "text"), 5) for r in rows]
                _, parts = _links(sets, _near)
                kept = [tuple(r) for r in out.collect()]
                assert len(kept) == len(set(kept)) == len(set(parts)) and set(kept) <= set(rows)
                number = {r: k for k, r in enumerate(rows)}
                assert {parts[number[r]] for r in kept} == set(parts)  # one row of each group
                least = {}
                for r, p in zip(rows, parts, strict=True):
                    order = (at(r, "doc_id") is None, at(r, "doc_id") or 0)
                    least[p] = min(least.get(p, order), order)
                assert all((at(r, "doc_id") is None, at(r, "doc_id") or 0) == least[parts[number[r]]] for r in kept)
            elif name == "personal_data":
                weights = pii.learned(docs)
                want = []
                for r in before:
                    row = list(r)
                    row[1] = None if r["text"] is None else pii.replace(r["text"], pii.find(r["text"], weights)[1])
                    row[4] = None if r["n_chars"] is None or row[1] is None else len(row[1])
                    want.append(row)
                assert _same(out, want)
            elif name == "mixing":
                # rows alike are copies of one document; a key of all columns decides ties of the stream's order
                keyed = docs.withColumn("_k", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(*names, *[F.col(k).isNull() for k in names]).cast("string")))
                key = {tuple(r)[:-1]: r["_k"] for r in keyed.collect()}
                plain, _, _ = _mixed([(r["doc_id"], r["text"], r["source"]) for r in before], ties=[key[tuple(r)] for r in before])
                want = Counter()
                for r, (times, _) in zip(before, plain, strict=True):
                    want[tuple(r)] += times
                assert spark_rows(out.collect()) == +want
            else:
                want = []
                for r in before:
                    ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
                    want.append((r["doc_id"], r["source"], len(ids), np.array(ids, "<u4").tobytes()))
                assert _same(out, want)
            if name != "encoding":
                assert out.columns == names
            last = out.collect()
            docs = spark.createDataFrame(last, out.schema)
        assert spark_rows(corpus_pipeline.run(spark, folder).collect()) == spark_rows(last)


def test_pipeline_near_duplicates_by_row(spark, tmp_path):
    """Null and repeated doc_ids: the decision is a row's, not a doc_id's."""
    rng = random.Random(5)
    a, b, x, d = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(80)) for _ in range(4))
    stay = [(1, a, "en", "s"), (2, b, "en", "s"), (3, x, "en", "s"), (None, None, "en", "s"), (4, None, "en", "s"), (4, "", "en", "s"), (5, None, "en", None), (5, None, None, "en")]
    go = [(2, a + " tail", "en", "s"), (3, b, "en", "s"), (3, x, "en", "s"), (None, a, "en", "s")]
    either = [(None, d, "en", "s"), (None, d + " tail", "en", "s")]
    docs = spark.createDataFrame([*go, *either, *stay], "doc_id long, text string, lang string, source string").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert len([r for r in got if r in either]) == 1
    assert sorted((r for r in got if r not in either), key=str) == sorted(stay, key=str)
