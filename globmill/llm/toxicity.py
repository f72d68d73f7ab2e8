"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (words of the training sample) plus the mean of its character trigrams' vectors
(hashed, so unknown words have them too). Overlapping windows of words run through one recurrent network in each
direction; attention pools the states and a logistic unit scores the pool. A text's score is that of its highest
window, over all windows of the whole text, put on the scale of probabilities by a fit on rows that the network didn't
learn from. Training learns from the window that scores highest in each document, and for clean ones a random one too.

The labelled rows for training are at most SAMPLE documents for each label, those with the least hashes, so its cost
doesn't grow with the table; scoring covers every row. Windows of WINDOW words begin every STRIDE words, so a passage of
up to WINDOW - STRIDE + 1 words lies whole in one.

Defined results: an empty table gives an empty result, repeated rows give a row each; null, empty and wordless texts score 0; with no rows of one label to learn from, every text scores 0.
Equal texts have equal scores. Further columns are left as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

#: Bounds of the training sample: documents of each label, and their characters.
SAMPLE, CHARS = 1500, 8_000_000
#: Words of a window, words from one window's start to the next one's, and the same while training.
WINDOW, STRIDE, STRIDE_TRAINING = 32, 4, 8
DIM, HIDDEN, ATTENTION, BUCKETS = 12, 8, 8, 4096
EPOCHS, BATCH, RATE, SEED = 6, 64, 8e-3, 7
#: Distinct words whose inputs a Python worker keeps, and windows scored at once.
STORE, AT_ONCE = 100_000, 2048
#: Windows and texts scored at once while training, and windows that share a table of their words: the driver's memory is smaller than a worker's.
AT_ONCE_TRAINING, TEXTS_TRAINING, LOT_TRAINING = 1024, 64, 16_384
#: Words spelled and projected at once: their trigrams' vectors take far more room than what becomes of them.
WORDS_AT_ONCE = 8192

#: Check sums of single bytes, of which zlib.crc32 is made up.
_CRC = np.array([zlib.crc32(bytes([0xFF ^ i])) ^ 0xFF000000 for i in range(256)], np.uint32)

words_of = re.compile(r"\w+").findall


def grams(word: str) -> list[int]:
    """Buckets of a word's character trigrams, its borders included; a long word's too."""
    w = f"^{word}$".encode()
    return [zlib.crc32(w[i : i + 3]) % BUCKETS for i in range(max(1, len(w) - 2))]


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of windows that cover n words; the last one ends with the text."""
    if n <= size:
        return [0]
    return [*range(0, n - size, stride), n - size]


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters, forward pass, backward pass. Word 0 is unknown (its own vector is zero), -1 is padding."""

    def __init__(self, vocab: dict[str, int], start: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        g = lambda *shape, s=1.0: rng.normal(0, s, shape)
        self.vocab = vocab
        ew = g(len(vocab) + 1, DIM, s=0.1)
        ew[:, 0] = start
        ew[0] = 0
        self.p = {"ew": ew, "ec": g(BUCKETS, DIM, s=0.05)}
        for side in "fb":
            self.p |= {f"w{side}": g(DIM, 3 * HIDDEN, s=DIM**-0.5), f"x{side}": np.zeros(3 * HIDDEN), f"u{side}": g(HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5), f"c{side}": np.zeros(3 * HIDDEN)}
        self.p |= {"wa": g(2 * HIDDEN, ATTENTION, s=0.3), "ba": np.zeros(ATTENTION), "va": g(ATTENTION, s=0.3), "wo": g(2 * HIDDEN, s=0.3), "bo": np.zeros(1)}
        self.scale = (1.0, 0.0)

    # --- inputs ---

    @staticmethod
    def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigram buckets of words, one after another, and where each word's begin: those of grams(), for all words at once."""
        raw = [f"^{w}$".encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        c = np.full(max(0, len(x) - 2), 0xFFFFFFFF, np.uint32)
        for k in range(3):
            c = _CRC[(c ^ x[k : len(x) - 2 + k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        ends = np.cumsum(size)
        keep = np.ones(len(c), bool)
        for back in (1, 2):
            keep[(ends[:-1] - back)] = False  # windows that begin in a word's last two bytes
        return ((c ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64)[keep], np.r_[0, np.cumsum(size - 2)]

    def inputs(self, ids: np.ndarray, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Vectors of distinct words."""
        mean = np.add.reduceat(self.p["ec"][buckets], ends[:-1], axis=0) / np.diff(ends)[:, None]
        return self.p["ew"][ids] + mean

    # --- one direction ---

    def _run(self, x: np.ndarray, side: str, mask: np.ndarray, keep: bool):
        u, b, h, n = self.p[f"u{side}"], self.p[f"c{side}"], HIDDEN, x.shape[1]
        u, b = u.astype(x.dtype), b.astype(x.dtype)
        state = np.zeros((x.shape[0], h), x.dtype)
        out, trail = np.empty((x.shape[0], n, h), x.dtype), []
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            a = state @ u + b
            zr = _sigmoid(x[:, t, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, t, 2 * h :] + r * a[:, 2 * h :])
            m = mask[:, t, None]
            before, state = state, np.where(m, new + z * (state - new), state)
            out[:, t] = state
            if keep:
                trail.append((t, before, z, r, new, a[:, 2 * h :], m))
        return out, trail

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: projected inputs of both directions (windows, words, 6 * HIDDEN). Logits, and what backward() needs."""
        f, tf = self._run(x[:, :, : 3 * HIDDEN], "f", mask, keep)
        b, tb = self._run(x[:, :, 3 * HIDDEN :], "b", mask, keep)
        states = np.concatenate([f, b], 2)
        e = np.tanh(states @ self.p["wa"].astype(x.dtype) + self.p["ba"].astype(x.dtype))
        s = np.where(mask, e @ self.p["va"].astype(x.dtype), -1e9)
        alpha = np.exp(s - s.max(1, keepdims=True))
        alpha /= alpha.sum(1, keepdims=True)
        pool = np.einsum("nt,nth->nh", alpha, states)
        return pool @ self.p["wo"].astype(x.dtype) + x.dtype.type(self.p["bo"][0]), (states, e, alpha, pool, tf, tb)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors @ self.p[f"w{s}"] + self.p[f"x{s}"] for s in "fb"], 1)

    def projected(self, ids: np.ndarray, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """project(inputs(...)) in single precision, a lot of words at a time."""
        out = np.empty((len(ids), 6 * HIDDEN), np.float32)
        for i in range(0, len(ids), WORDS_AT_ONCE):
            own = ends[i : i + WORDS_AT_ONCE + 1]
            out[i : i + WORDS_AT_ONCE] = self.project(self.inputs(ids[i : i + WORDS_AT_ONCE], buckets[own[0] : own[-1]], own - own[0]))
        return out

    def backward(self, d: np.ndarray, kept, vectors, place, ids, buckets, ends) -> dict[str, np.ndarray]:
        """Gradients from those of the logits; place: (windows, words) -> row of vectors."""
        p, h = self.p, HIDDEN
        states, e, alpha, pool, tf, tb = kept
        g = {"wo": pool.T @ d, "bo": np.array([d.sum()])}
        dpool = d[:, None] * p["wo"]
        dalpha = np.einsum("nh,nth->nt", dpool, states)
        ds = alpha * (dalpha - (alpha * dalpha).sum(1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", ds, e)
        de = ds[:, :, None] * p["va"] * (1 - e * e)
        g["wa"], g["ba"] = np.einsum("nth,nta->ha", states, de), de.sum((0, 1))
        dstates = alpha[:, :, None] * dpool[:, None, :] + de @ p["wa"].T
        dvec = np.zeros_like(vectors)
        for side, trail, cut in (("f", tf, slice(0, h)), ("b", tb, slice(h, 2 * h))):
            u = p[f"u{side}"]
            gu, gc, dx = np.zeros_like(u), np.zeros(3 * h), np.zeros((*place.shape, 3 * h))
            dh = np.zeros((len(d), h))
            for t, before, z, r, new, an, m in reversed(trail):
                dh = dh + dstates[:, t, cut]
                on = np.where(m, dh, 0)
                dn = on * (1 - z) * (1 - new * new)
                dz, dr = on * (before - new) * z * (1 - z), dn * an * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], 1)
                dx[:, t] = np.concatenate([dz, dr, dn], 1)
                gu += before.T @ da
                gc += da.sum(0)
                dh = np.where(m, on * z + da @ u.T, dh)
            flat = dx.reshape(-1, 3 * h)
            sums = np.zeros((len(vectors), 3 * h))
            np.add.at(sums, place.ravel(), flat)
            g[f"u{side}"], g[f"c{side}"], g[f"w{side}"], g[f"x{side}"] = gu, gc, vectors.T @ sums, sums.sum(0)
            dvec += sums @ p[f"w{side}"].T
        g["ew"], g["ec"] = np.zeros_like(p["ew"]), np.zeros_like(p["ec"])
        np.add.at(g["ew"], ids, dvec)
        g["ew"][0] = 0
        size = np.diff(ends)
        np.add.at(g["ec"], buckets, np.repeat(dvec / size[:, None], size, axis=0))
        return g

    # --- scoring ---

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; keeps the projected inputs of the words seen."""

    def __init__(self, net: Network):
        self.net, self.rows, self.table = net, {}, np.zeros((1, 6 * HIDDEN), np.float32)
        # a gate is 0.5 + 0.5 tanh(x / 2): the halves are in the parameters
        f = lambda k: np.ascontiguousarray(net.p[k].T, np.float32)
        self.small = {k: 0.5 * f(k) for k in ("uf", "ub")} | {k: 0.5 * f(k)[:, None] for k in ("cf", "cb")}
        self.small |= {k: f(k) for k in ("wa", "va", "wo")} | {"ba": f("ba")[:, None], "bo": np.float32(net.p["bo"][0])}
        self.half = np.tile(np.r_[np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)], 2).astype(np.float32)

    def _add(self, words: set[str]) -> None:
        if len(self.rows) > STORE:
            self.rows, self.table = {}, self.table[:1]
        if new := [w for w in words if w not in self.rows]:
            buckets, ends = self.net.spell(new)
            ids = np.fromiter((self.net.vocab.get(w, 0) for w in new), np.int64, len(new))
            got = self.net.projected(ids, buckets, ends)
            got *= self.half
            self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, got])

    def logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """Logits of all windows of each text; none for a text without words."""
        tokens = [words_of(t.lower()) if t else [] for t in texts]
        self._add({w for x in tokens for w in x})
        get = self.rows.__getitem__
        ids = [np.fromiter(map(get, x), np.int32, len(x)) for x in tokens]
        # windows that begin on the grid of a text: all texts in a row, each from a place of the grid on
        long = [k for k, x in enumerate(ids) if len(x) >= WINDOW]
        room = np.array([-(-len(ids[k]) // STRIDE) * STRIDE for k in long], np.int64)
        begin = np.r_[0, np.cumsum(room)]
        row = np.zeros(int(begin[-1]), np.int32)
        for k, at in zip(long, begin.tolist(), strict=False):
            row[at : at + len(ids[k])] = ids[k]
        grid = self._grid(row)
        # the others: a text's last one, and the only one of a short text, filled up
        odd = [k for k, x in enumerate(ids) if 0 < len(x) < WINDOW or len(x) > WINDOW and (len(x) - WINDOW) % STRIDE]
        last = np.zeros((len(odd), WINDOW), np.int32)
        for j, k in enumerate(odd):
            part = ids[k][-WINDOW:]
            last[j, : len(part)] = part
        tail = dict(zip(odd, np.concatenate([np.zeros(0, np.float32), *(self._windows(last[i : i + AT_ONCE]) for i in range(0, len(odd), AT_ONCE))]), strict=True))
        at = dict(zip(long, begin.tolist(), strict=False))
        out = []
        for k, x in enumerate(ids):
            own = grid[at[k] // STRIDE : at[k] // STRIDE + (len(x) - WINDOW) // STRIDE + 1] if k in at else grid[:0]
            out.append(np.append(own, tail[k]) if k in tail else own)
        return out

    def _grid(self, row: np.ndarray) -> np.ndarray:
        """Logits of the windows at every STRIDE-th place of a row of word numbers (its length a multiple of STRIDE)."""
        total = max(0, (len(row) - WINDOW) // STRIDE + 1)
        out = [np.zeros(0, np.float32)]
        for i in range(0, total, AT_ONCE):
            n = min(AT_ONCE, total - i)
            x = self.table[row[i * STRIDE : (i + n - 1) * STRIDE + WINDOW]].T
            # a step's inputs are every STRIDE-th column: dealt by their phase they lie side by side
            phase = [np.ascontiguousarray(x[:, k::STRIDE]) for k in range(STRIDE)]
            out.append(self._run([phase[t % STRIDE][:, t // STRIDE : t // STRIDE + n] for t in range(WINDOW)], n))
        return np.concatenate(out)

    def _windows(self, where: np.ndarray) -> np.ndarray:
        """Logits of windows given as rows of word numbers, 0 where a text is too short."""
        steps = np.ascontiguousarray(where.T)
        return self._run([np.ascontiguousarray(self.table[w].T) for w in steps], len(where), steps == 0 if (steps == 0).any() else None)

    def _run(self, inputs: list[np.ndarray], n: int, blank: np.ndarray | None = None) -> np.ndarray:
        """Logits of n windows, one window a column, so that a step's numbers lie side by side. inputs: a table (6 * HIDDEN, n) for each word of the windows, halved for the gates."""
        h, p = HIDDEN, self.small
        states = np.empty((WINDOW, 2 * h, n), np.float32)
        a, new, d = np.empty((3 * h, n), np.float32), np.empty((h, n), np.float32), np.empty((h, n), np.float32)
        for side, cut in (("f", 0), ("b", h)):
            state, u, b = np.zeros((h, n), np.float32), p[f"u{side}"], p[f"c{side}"]
            for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                x = inputs[t][3 * cut : 3 * cut + 3 * h]
                np.matmul(u, state, out=a)
                a += b
                gate = a[: 2 * h]
                gate += x[: 2 * h]
                np.tanh(gate, out=gate)  # twice a gate, less 1
                np.multiply(gate[h:], a[2 * h :], out=new)
                new += a[2 * h :]
                new += x[2 * h :]
                np.tanh(new, out=new)
                state -= new
                np.multiply(state, gate[:h], out=d)
                d += state
                d *= np.float32(0.5)
                np.add(new, d, out=state)
                if blank is not None:
                    # padding stands behind a text's words: forwards the state stays, backwards it is still zero
                    state[:, blank[t]] = states[t - 1, cut : cut + h][:, blank[t]] if side == "f" and t else 0
                states[t, cut : cut + h] = state
        e = np.matmul(p["wa"], states)
        e += p["ba"]
        np.tanh(e, out=e)
        score = np.matmul(p["va"], e)
        if blank is not None:
            score[blank] = -1e9
        score -= score.max(0)
        np.exp(score, out=score)
        score /= score.sum(0)
        return (score * np.matmul(p["wo"], states)).sum(0) + p["bo"]

    def scores(self, texts: list[str | None]) -> list[float]:
        a, b = self.net.scale
        return [float(_sigmoid(a * np.float64(x.max()) + b)) if len(x) else 0.0 for x in self.logits(texts)]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """Fit the network; every fifth row fits the scale of the scores instead. None if a label is missing or there are no words."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    learn, scale = order[np.arange(len(y)) % 5 > 0], order[np.arange(len(y)) % 5 == 0]
    if len(set(y[learn])) < 2:
        learn = order
    number: dict[str, int] = {}  # the sample's words, numbered; a text is a row of numbers
    tokens = [np.fromiter((number.setdefault(w, len(number)) for w in words_of((t or "").lower())), np.int32) for t in texts]
    if not any(len(tokens[i]) for i in learn):
        return None
    df = np.zeros((2, len(number)), np.int64)
    for i in learn:
        df[int(y[i]), np.unique(tokens[i])] += 1
    n = [int((y[learn] == k).sum()) for k in (0, 1)]
    told = df.sum(0)
    vocab = {w: i + 1 for i, w in enumerate(sorted(w for w, k in number.items() if told[k] >= 3))}
    start = np.zeros(len(vocab) + 1)
    for w, i in vocab.items():
        (clean, toxic), total = df[:, number[w]], told[number[w]]
        start[i] = np.clip((np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))) * total / (total + 5), -2, 4)
    net = Network(vocab, start, seed)
    words = sorted(w for w, k in number.items() if told[k])
    rows = np.zeros(len(number), np.int32)
    rows[np.fromiter((number[w] for w in words), np.int64, len(words))] = np.arange(len(words))
    ids = np.array([vocab.get(w, 0) for w in words])
    spelled = [net.spell(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
    buckets = np.concatenate([x.astype(np.int32) for x, _ in spelled])
    ends = np.r_[0, np.cumsum(np.concatenate([np.diff(e) for _, e in spelled]))]
    # all texts in a row, short ones filled up to a window, and where their windows begin
    learn = [i for i in learn if len(tokens[i])]
    lie = np.r_[0, np.cumsum([max(WINDOW, len(tokens[i])) for i in learn])]
    row = np.full(int(lie[-1]), -1, np.int32)
    begin, of = [], [int(y[i]) for i in learn]
    for i, at in zip(learn, lie.tolist(), strict=False):
        row[at : at + len(tokens[i])] = rows[tokens[i]]
        begin.append(at + np.array(windows(len(tokens[i]), stride=STRIDE_TRAINING)))
    cuts = np.r_[0, np.cumsum([len(x) for x in begin])]
    begin = np.concatenate(begin)
    cut = lambda at: row[at[:, None] + np.arange(WINDOW)]
    del number, tokens, words, rows, spelled, df, told
    weight = {1: 1.0, 0: n[1] / max(1, n[0]) if n[1] < n[0] else 1.0}
    lifted = np.maximum(start[ids], 0)
    best = [int(np.where((w := cut(begin[a:b])) >= 0, lifted[w], 0).sum(1).argmax()) for a, b in zip(cuts, cuts[1:], strict=False)]
    m, v, step = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}, 0
    for epoch in range(epochs):
        if epoch:
            got = np.concatenate([_logits_training(net, row, begin[i : i + LOT_TRAINING], ids, buckets, ends) for i in range(0, len(begin), LOT_TRAINING)])
            best = [int(got[a:b].argmax()) for a, b in zip(cuts, cuts[1:], strict=False)]
        items = [(label, a + k) for label, a, k in zip(of, cuts, best, strict=False)] + [(0, a + rng.integers(b - a)) for label, a, b in zip(of, cuts, cuts[1:], strict=False) if not label]
        by = rng.permutation(len(items))
        for k in range(0, len(by), BATCH):
            part = [items[i] for i in by[k : k + BATCH]]
            w, t = cut(begin[[x for _, x in part]]), np.array([x for x, _ in part], float)
            mask = w >= 0
            used, place = np.unique(np.where(mask, w, w[:, :1]), return_inverse=True)
            place = place.reshape(w.shape)
            own = _some(used, ids, buckets, ends)
            vectors = net.inputs(*own)
            logit, kept = net.forward(net.project(vectors)[place], mask, True)
            d = (_sigmoid(logit) - t) * np.where(t > 0, weight[1], weight[0]) / len(part)
            g = net.backward(d, kept, vectors, place, *own)
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for name, grad in g.items():
                m[name] += 0.1 * (grad - m[name])
                v[name] += 0.001 * (grad * grad - v[name])
                net.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    del row, begin, cut, ids, buckets, ends, m, v
    fit = scale if len(set(y[scale])) > 1 else learn
    own = net.scorer()
    tops = np.array([x.max() if len(x) else np.nan for k in range(0, len(fit), TEXTS_TRAINING) for x in own.logits([texts[i] for i in fit[k : k + TEXTS_TRAINING]])], float)
    truth = y[fit][np.isfinite(tops)]
    net.scale = _fit_scale(tops[np.isfinite(tops)], truth)
    return net


def _logits_training(net: Network, row: np.ndarray, begin: np.ndarray, ids: np.ndarray, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Logits of the windows that begin there (ascending) in the row; only the words between the first and the last are projected."""
    between = row[begin[0] : begin[-1] + WINDOW]
    stands = np.zeros(len(ids), bool)
    stands[between[between >= 0]] = True
    used = np.flatnonzero(stands)
    local = np.zeros(len(ids), np.int32)
    local[used] = np.arange(len(used))
    local = np.where(between >= 0, local[between], 0)
    table, out = net.projected(*_some(used, ids, buckets, ends)), []
    for i in range(0, len(begin), AT_ONCE_TRAINING):
        where = begin[i : i + AT_ONCE_TRAINING, None] - begin[0] + np.arange(WINDOW)
        out.append(net.forward(table[local[where]], between[where] >= 0)[0])
    return np.concatenate(out)


def _some(used: np.ndarray, ids: np.ndarray, buckets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, trigram buckets and their bounds of some of the words."""
    size = np.diff(ends)[used]
    own = np.r_[0, np.cumsum(size)]
    return ids[used], buckets[np.repeat(ends[used] - own[:-1], size) + np.arange(own[-1])], own


def _fit_scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset of a logistic fit, slightly drawn towards (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * x + b)
        w = q * (1 - q)
        grad = np.array([((q - y) * x).sum() + 0.5 * (a - 1), (q - y).sum() + 0.1 * b])
        hess = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return float(max(a, 0.05)), float(b)


def training_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, chars: int = CHARS) -> list:
    """Texts and labels to learn from: rows of the fold, at most `bound` of each label by hash, and at most `chars` characters of each label in all.

    The ids are drawn first and are few, so they are broadcast. Of a doc_id's texts the least is taken. Texts longer than
    a twentieth of `chars` aren't learned from; they are scored like all others.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & (c.crc_mod(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = c.sampled(rows, ["doc_id"], bound, "toxic")
    x = docs.where(F.length("text") <= chars // 20).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.length("text")).over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id")))
    return sorted(x.withColumn("_upto", upto).where(F.col("_upto") <= chars).select("doc_id", "text", "toxic").collect(), key=lambda r: (r["doc_id"], r["text"]))


def learned(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Network | None:
    rows = training_sample(docs, labels, bound)
    texts, toxic = [r["text"] for r in rows], [int(r["toxic"]) for r in rows]
    del rows
    net = train(texts, toxic)
    del texts
    c.give_back()
    return net


def score(text: Column, net: Network | None) -> Column:
    """Scores of a text column (0 to 1)."""
    if net is None:
        return F.when(text.isNull(), F.lit(0.0)).otherwise(F.lit(0.0))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = net.scorer()
        for texts in batches:
            yield pd.Series(own.scores(texts.where(texts.notna(), None).tolist()), index=texts.index, dtype="float64")

    return scored(text)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    net = learned(docs, c.table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (c.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score(F.col("text"), net).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
