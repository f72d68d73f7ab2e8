"""Estimators that learn: recurrent over characters (with the loss on all prefixes, or pooled by attention), conditional
chains, embeddings from triplets, corrections of a bound, sampled bits, and trees of plans.

Each is trained on the driver from at most SAMPLE labelled patterns (drawn by md5), which bounds its memory; estimates are
made for all patterns by Arrow batches. Results are counts, 0 at least and the number of strings at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import counting as C
from ..operators import estimators as E
from ..operators import reports as R
from ..operators import statistics as S
from .tape import Parameters, Value, concat, softmax, stack, train, value

#: Bounds: labelled patterns learned from, characters of the vocabulary, rows that bits are taken of, triplets learned from.
SAMPLE, LETTERS, BITS, TRIPLETS = 2000, 200, 64, 2000


def drawn(labelled: DataFrame, most: int = SAMPLE, seed: str = "0") -> list[tuple[str, int]]:
    x = S.shuffled_rank(labelled.select("pattern", "card").dropDuplicates(["pattern"]), "pattern", seed).where(F.col("rank") < most)
    return sorted((r["pattern"], r["card"]) for r in x.collect())  # bounded by `most`


class Base:
    """What the models share: the vocabulary, the scale of counts, and the application by batches."""

    def __init__(self, settings=None, width: int = 16, epochs: int = 20, rate: float = 0.01, seed: int = 0):
        self.settings, self.width, self.epochs, self.rate, self.seed = settings, width, epochs, rate, seed
        self.p, self.told = Parameters(seed), []

    def fit(self, strings: DataFrame, labelled: DataFrame | None = None) -> "Base":
        if labelled is None:
            raise ValueError("this estimator learns from labelled patterns")
        self.n = int(strings.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
        self.letters = {ch: i + 2 for i, ch in enumerate(["%", "_", *[r["ch"] for r in R.vocabulary(strings, LETTERS).orderBy("idx").collect()]])}
        self.learn(strings, drawn(labelled))
        return self

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character codes (0 fills up, 1 is unknown) and lengths."""
        size = np.array([max(1, len(t)) for t in texts])
        out = np.zeros((len(texts), int(size.max(initial=1))), int)
        for k, t in enumerate(texts):
            out[k, : len(t)] = [self.letters.get(ch, 1) for ch in t]
        return out, size

    def scaled(self, card) -> np.ndarray:
        return np.log1p(np.asarray(card, float)) / max(1e-9, np.log1p(self.n))

    def counts(self, scaled: np.ndarray) -> np.ndarray:
        return np.expm1(np.clip(scaled, 0, 1) * np.log1p(self.n))

    def predict(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def estimate(self, patterns: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"pattern": b["pattern"], "est": self.predict(b["pattern"].tolist()) if len(b) else []})

        p = patterns.select("pattern").distinct()
        return p.mapInPandas(run, "pattern string, est double")

    def size(self) -> int:
        return self.p.bytes()


def canonical(q: str, flip: bool = True) -> str:
    """The canonical form of a pattern, as functions.patterns.canonical gives it."""
    runs = re.findall(r"[%_]+|[^%_]+", q)
    one = lambda r: "%" + r.replace("%", "") if "%" in r and r[0] in "%_" else r
    out = [one(r) for r in runs]
    if flip and out and out[-1][0] in "%_" and "%" in out[-1]:
        out[-1] = out[-1].replace("%", "") + "%"
    return "".join(out)


def lstm(p: dict[str, Value], x: Value, mask: np.ndarray, name: str, width: int) -> list[Value]:
    """States after each place; padding keeps them. x: (rows, places, inputs)."""
    h = c = value(np.zeros((x.data.shape[0], width)))
    out = []
    for t in range(x.data.shape[1]):
        a = x.take((slice(None), t)) @ p[f"{name}_x"] + h @ p[f"{name}_h"] + p[f"{name}_b"]
        i, f, o, g = (a.take((slice(None), slice(k * width, (k + 1) * width))) for k in range(4))
        new = f.sigmoid() * c + i.sigmoid() * g.tanh()
        on = value(mask[:, t : t + 1].astype(float))
        c = new * on + c * (1.0 - on.data)
        h = (o.sigmoid() * new.tanh()) * on + h * (1.0 - on.data)
        out.append(h)
    return out


class Recurrent(Base):
    """A long short-term memory over a pattern's characters; every prefix has a count to learn (packed), or the whole alone. pool: `last`, or `attention` over all states."""

    def __init__(self, settings=None, packed: bool = True, pool: str = "last", **more):
        super().__init__(settings, **more)
        self.packed, self.pool = packed and pool == "last", pool

    def learn(self, strings: DataFrame, rows: list[tuple[str, int]]) -> None:
        texts, w = [canonical(q) for q, _ in rows], self.width
        label = np.zeros((len(rows), max(map(len, texts), default=1)))
        mask = np.zeros_like(label, bool)
        for k, (t, (_, card)) in enumerate(zip(texts, rows, strict=True)):
            label[k, max(0, len(t) - 1)], mask[k, max(0, len(t) - 1)] = card, True
        if self.packed:
            at = {t: k for k, t in enumerate(texts)}
            p = strings.sparkSession.createDataFrame([(t,) for t in at], "pattern string")
            for r in C.prefix_cards(strings, p, form=lambda q: q).collect():  # as many rows as the sample has characters
                label[at[r["pattern"]], r["prefix_len"] - 1], mask[at[r["pattern"]], r["prefix_len"] - 1] = r["card"], True
        codes, _ = self.codes(texts)
        self.p.add("letters", len(self.letters) + 2, w, scale=0.3)
        for name, a in (("l_x", w), ("l_h", w)):
            self.p.add(name, a, 4 * w)
        self.p.add("l_b", 4 * w, scale=0)
        self.p.add("att", w, 1)
        self.p.add("out", w, 1)
        self.p.add("out_b", 1, scale=0)
        goal = self.scaled(label)

        def loss(p, part):
            longest = int((codes[part] > 0).sum(1).max(initial=1))
            got = self.forward(p, codes[part][:, : max(1, longest)])
            m = mask[part][:, : got.data.shape[1]].astype(float)
            d = (got - goal[part][:, : got.data.shape[1]]) * m
            return (d * d).sum() * (1.0 / max(1.0, m.sum()))

        self.told = train(self.p, loss, len(rows), self.epochs, rate=self.rate, seed=self.seed)

    def forward(self, p: dict[str, Value], codes: np.ndarray) -> Value:
        """Scaled counts after each place."""
        mask = codes > 0
        states = stack(lstm(p, p["letters"].take(codes), mask, "l", self.width), 1)
        if self.pool == "attention":
            score = (states.tanh() @ p["att"]) + np.where(mask, 0.0, -1e9)[:, :, None]
            pooled = (softmax(score, 1) * states).sum(1, True)
            states = states * 0.0 + pooled
        return (states @ p["out"] + p["out_b"]).reshape(codes.shape[0], codes.shape[1])

    def predict(self, texts: list[str]) -> np.ndarray:
        codes, size = self.codes([canonical(t) for t in texts])
        got = self.forward(self.p.opened(), codes).data
        return np.minimum(self.counts(got[np.arange(len(texts)), size - 1]), self.n)


class Chained(Base):
    """Conditional probabilities along a pattern's chain of steps, by a gated unit; the product times all strings is the estimate. The loss is cross-entropy over the steps that are there."""

    def symbols(self, steps: list[str]) -> list[str]:
        """What each step adds: the wildcards before its last character, and the character."""
        out = []
        for s in steps:
            m = re.search(r"([%_]*)([^%_])([%_]*)$", s)
            out.append(m[1] + "\0" + m[2] + ("" if s.endswith("%") and m[3] == "%" else "\1" + m[3]) if m else s)
        return out

    def chains(self, patterns: DataFrame) -> DataFrame:
        q = P.canonical(F.col("pattern"))
        return patterns.select("pattern", F.coalesce(P.conditional_steps(q), F.array().cast("array<string>")).alias("steps"))

    def learn(self, strings: DataFrame, rows: list[tuple[str, int]]) -> None:
        spark, w = strings.sparkSession, self.width
        x = self.chains(spark.createDataFrame([(q,) for q, _ in rows], "pattern string"))
        chains = sorted(((r["pattern"], r["steps"]) for r in x.collect()), key=lambda r: r[0])
        wanted = spark.createDataFrame(sorted({(s,) for _, c in chains for s in c}), "pattern string")
        card = {r["pattern"]: r["card"] for r in C.typed(strings, wanted).collect()}  # the sample's steps
        self.known = {s: i + 2 for i, s in enumerate(sorted({s for _, c in chains for s in self.symbols(c)}))}
        longest = max((len(c) for _, c in chains), default=1)
        codes, goal = np.zeros((len(chains), max(1, longest)), int), np.zeros((len(chains), max(1, longest)))
        for k, (_, c) in enumerate(chains):
            up = self.n
            for i, (s, sign) in enumerate(zip(c, self.symbols(c), strict=True)):
                codes[k, i], goal[k, i] = self.known[sign], card[s] / up if up else 0.0
                up = card[s]
        self.p.add("signs", len(self.known) + 2, w, scale=0.3)
        for name in ("zr", "n"):
            self.p.add(f"x_{name}", w, (2 if name == "zr" else 1) * w)
            self.p.add(f"h_{name}", w, (2 if name == "zr" else 1) * w)
            self.p.add(f"b_{name}", (2 if name == "zr" else 1) * w, scale=0)
        self.p.add("out", w, 1)
        self.p.add("out_b", 1, scale=0)

        def loss(p, part):
            m = (codes[part] > 0).astype(float)
            y = goal[part]
            q = self.forward(p, codes[part]) * (1 - 2e-7) + 1e-7
            each = (q.log() * y + (q * -1.0 + 1.0).log() * (1 - y)) * -1.0
            return (each * m).sum() * (1.0 / max(1.0, m.sum()))

        self.told = train(self.p, loss, len(chains), self.epochs, rate=self.rate, seed=self.seed)

    def forward(self, p: dict[str, Value], codes: np.ndarray) -> Value:
        x, w, out = p["signs"].take(codes), self.width, []
        h = value(np.zeros((len(codes), w)))
        for t in range(codes.shape[1]):
            v = x.take((slice(None), t))
            zr = (v @ p["x_zr"] + h @ p["h_zr"] + p["b_zr"]).sigmoid()
            z, r = zr.take((slice(None), slice(0, w))), zr.take((slice(None), slice(w, 2 * w)))
            new = (v @ p["x_n"] + (r * h) @ p["h_n"] + p["b_n"]).tanh()
            h = new + z * (h - new)
            out.append((h @ p["out"] + p["out_b"]).sigmoid())
        return concat(out, 1)

    def estimate(self, patterns: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                chains = [list(c) for c in b["steps"]]
                codes = np.zeros((len(b), max(1, max(map(len, chains), default=1))), int)
                for k, c in enumerate(chains):
                    codes[k, : len(c)] = [self.known.get(s, 1) for s in self.symbols(c)]
                p = self.forward(self.p.opened(), codes).data
                est = np.exp(np.where(codes > 0, np.log(np.maximum(p, 1e-12)), 0).sum(1)) * self.n
                yield pd.DataFrame({"pattern": b["pattern"], "est": est})

        return self.chains(patterns.select("pattern").distinct()).mapInPandas(run, "pattern string, est double")


class Corrected(Recurrent):
    """An n-gram table's exact counts where it has them; else its bound times a factor between 0 and 1 that a recurrent network learns from the pattern and the bound."""

    def __init__(self, settings=None, **more):
        super().__init__(settings, packed=False, **more)

    def learn(self, strings: DataFrame, rows: list[tuple[str, int]]) -> None:
        k = self.settings
        self.grams, self.least = (k.grams, k.threshold) if k else (5, 1)
        self.table = S.ngram_table(strings, self.grams).where(F.col("cnt") >= self.least)
        p = strings.sparkSession.createDataFrame([(q,) for q, _ in rows], "pattern string")
        bounds = {r["pattern"]: r["bound"] for r in S.upper_bound(self.table, p, self.grams, self.least).collect()}
        codes, size = self.codes([canonical(q) for q, _ in rows])
        bound, card, w = np.log1p([bounds[q] for q, _ in rows]), np.log1p([c for _, c in rows]), self.width
        self.p.add("letters", len(self.letters) + 2, w, scale=0.3)
        for name, a in (("l_x", w), ("l_h", w), ("mid", w + 1)):
            self.p.add(name, a, w if name == "mid" else 4 * w)
        self.p.add("l_b", 4 * w, scale=0)
        self.p.add("out", w, 1)
        self.p.add("out_b", 1, scale=0)

        def loss(p, part):
            # the factor's logarithm in the counts' logarithm
            d = self.factor(p, codes[part], size[part], bound[part]).log() + (bound[part] - card[part])
            return (d * d).sum() * (1.0 / len(part))

        self.told = train(self.p, loss, len(rows), self.epochs, rate=self.rate, seed=self.seed)

    def factor(self, p: dict[str, Value], codes: np.ndarray, size: np.ndarray, bound: np.ndarray) -> Value:
        states = stack(lstm(p, p["letters"].take(codes), codes > 0, "l", self.width), 1)
        last = states.take((np.arange(len(codes)), size - 1))
        mid = (concat([last, value(bound[:, None] / max(1e-9, np.log1p(self.n)))], 1) @ p["mid"]).tanh()
        return ((mid @ p["out"] + p["out_b"]).sigmoid() * (1 - 1e-6) + 1e-6).reshape(len(codes))

    def estimate(self, patterns: DataFrame) -> DataFrame:
        p = patterns.select("pattern").distinct()
        x = S.upper_bound(self.table, p, self.grams, self.least).join(R.exact_hits(self.table, p, self.grams), "pattern", "left")
        net = {k: getattr(self, k) for k in ("p", "letters", "n", "width")}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Corrected.__new__(Corrected)
            own.__dict__.update(net)
            for b in batches:
                codes, size = own.codes([canonical(q) for q in b["pattern"]])
                f = own.factor(own.p.opened(), codes, size, np.log1p(b["bound"].to_numpy(float))).data
                est = np.maximum(0, np.expm1(np.log1p(b["bound"].to_numpy(float)) + np.log(f)))
                yield pd.DataFrame({"pattern": b["pattern"], "est": np.where(b["cnt"].isna(), est, b["cnt"].fillna(0))})

        return x.select("pattern", "bound", "cnt").mapInPandas(run, "pattern string, est double")

    def size(self) -> int:
        return self.p.bytes() + int(self.table.agg(F.coalesce(F.sum(F.octet_length("gram") + 8), F.lit(0))).first()[0])


class Embedded(Base):
    """Embeddings of parts by a convolution over their characters, learned from triplets (a node of the prefix tree, a near one, any other) with a margin; a network reads the mean of a pattern's parts, each with its kind."""

    KINDS, MARGIN = ("prefix", "suffix", "substring"), 0.5

    def learn(self, strings: DataFrame, rows: list[tuple[str, int]]) -> None:
        w = self.width
        x = E.drawn_triplets(S.transitions(strings), 2).withColumn("_k", F.concat_ws("\0", "anchor", F.col("draw").cast("string")))
        told = [tuple(r) for r in S.shuffled_rank(x, "_k").where(F.col("rank") < TRIPLETS).select("anchor", "positive", "negative").collect()]
        self.p.add("letters", len(self.letters) + 2, w, scale=0.3)
        self.p.add("conv", 3 * w, w)
        self.p.add("conv_b", w, scale=0)
        self.p.add("mid", w + len(self.KINDS), 2 * w)
        self.p.add("mid_b", 2 * w, scale=0)
        self.p.add("out", 2 * w, 1)
        self.p.add("out_b", 1, scale=0)
        sides = [self.codes([t[k] for t in told])[0] for k in range(3)]

        def near(p, part):
            a, b, c = (self.embed(p, s[part]) for s in sides)
            gap = lambda u, v: ((u - v) * (u - v)).sum(1)
            return (gap(a, b) - gap(a, c) + self.MARGIN).relu().sum() * (1.0 / len(part))

        self.near = train(self.p, near, len(told), max(1, self.epochs // 4), rate=self.rate, seed=self.seed) if told else []
        goal = self.scaled([c for _, c in rows])
        read = [self.parts(q) for q, _ in rows]

        def loss(p, part):
            d = self.forward(p, [read[k] for k in part]) - goal[part]
            return (d * d).sum() * (1.0 / len(part))

        self.told = train(self.p, loss, len(rows), self.epochs, rate=self.rate, seed=self.seed)

    def parts(self, q: str) -> list[tuple[str, int]]:
        """Parts with the number of their kind, as reports.typed_parts gives them; a pattern of wildcards alone has one empty part."""
        c = canonical(q)
        ps = [t for t in c.split("%") if t]
        kinds = [2] * len(ps)
        if ps and not c.startswith("%") and c.endswith("%"):
            kinds[0] = 0
        elif ps and c.startswith("%") and not c.endswith("%"):
            kinds[-1] = 1
        return list(zip(ps, kinds, strict=True)) or [("", 2)]

    def embed(self, p: dict[str, Value], codes: np.ndarray) -> Value:
        """A convolution over three characters at each place, the greatest of all places taken."""
        c = np.pad(codes, ((0, 0), (1, 1)))
        x = concat([p["letters"].take(c[:, k : k + codes.shape[1]]) for k in range(3)], 2)
        y = (x @ p["conv"] + p["conv_b"]).tanh() + np.where(codes > 0, 0.0, -4.0)[:, :, None]
        return y.max(1)

    def forward(self, p: dict[str, Value], read: list[list[tuple[str, int]]]) -> Value:
        flat = [x for ps in read for x in ps]
        owner = np.repeat(np.arange(len(read)), [len(ps) for ps in read])
        e = self.embed(p, self.codes([t for t, _ in flat])[0])
        e = concat([e, value(np.eye(len(self.KINDS))[[k for _, k in flat]])], 1)
        mean = np.zeros((len(read), len(flat)))
        mean[owner, np.arange(len(flat))] = 1 / np.bincount(owner, minlength=len(read))[owner]
        mid = ((value(mean) @ e) @ p["mid"] + p["mid_b"]).relu()
        return (mid @ p["out"] + p["out_b"]).reshape(len(read))

    def predict(self, texts: list[str]) -> np.ndarray:
        return np.minimum(self.counts(self.forward(self.p.opened(), [self.parts(t) for t in texts]).data), self.n)


class Bits(Base):
    """Bits of sampled strings (which match), the kind of pattern and its lengths, read by two layers; counts by scaled logarithms."""

    def learn(self, strings: DataFrame, rows: list[tuple[str, int]]) -> None:
        self.rows = [r["s"] for r in S.sample(strings, "s", BITS).select("s").collect()]
        x, goal, w = self.features([q for q, _ in rows]), self.scaled([c for _, c in rows]), self.width
        self.p.add("one", x.shape[1], 2 * w)
        self.p.add("one_b", 2 * w, scale=0)
        self.p.add("two", 2 * w, 1)
        self.p.add("two_b", 1, scale=0)

        def loss(p, part):
            d = self.forward(p, x[part]) - goal[part]
            return (d * d).sum() * (1.0 / len(part))

        self.told = train(self.p, loss, len(rows), self.epochs, rate=self.rate, seed=self.seed)

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.rows) + 7))
        for k, q in enumerate(texts):
            form = re.compile("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in q), re.S).fullmatch
            a, b = q.startswith("%"), q.endswith("%")
            tokens = re.findall("[^%_]+", q)
            bits = [float(bool(form(s))) for s in self.rows]
            out[k] = [*bits, sum(bits) / max(1, len(bits)), a and b, b and not a, a and not b, not a and not b, len(tokens) / 4, sum(map(len, tokens)) / 16]
        return out

    def forward(self, p: dict[str, Value], x: np.ndarray) -> Value:
        return ((value(x) @ p["one"] + p["one_b"]).relu() @ p["two"] + p["two_b"]).reshape(len(x))

    def predict(self, texts: list[str]) -> np.ndarray:
        return np.minimum(self.counts(self.forward(self.p.opened(), self.features(texts)).data), self.n)

    def size(self) -> int:
        return super().size() + sum(len(s.encode()) for s in self.rows)


class PlanTree:
    """A memory cell over a plan's tree: a node reads its kind and the mean of its children's states; the root tells two numbers, such as the logarithms of cost and rows."""

    def __init__(self, kinds: int, width: int = 12, epochs: int = 60, rate: float = 0.02, seed: int = 0):
        self.kinds, self.width, self.epochs, self.rate, self.seed = kinds, width, epochs, rate, seed
        self.p = Parameters(seed)
        self.p.add("x", kinds, 4 * width)
        self.p.add("h", width, 4 * width)
        self.p.add("b", 4 * width, scale=0)
        self.p.add("out", width, 2)
        self.p.add("out_b", 2, scale=0)

    def root(self, p: dict[str, Value], levels: list) -> Value:
        """levels: as plans.features.levels gives them, from the root down: (one-hot kind, places of the children in the next level, from 1)."""
        w, h, c = self.width, None, None
        for level in reversed(levels):
            one = value(np.array([k for k, _ in level], float))
            if h is None:
                up = cell = value(np.zeros((len(level), w)))
            else:
                mean = np.zeros((len(level), h.data.shape[0]))
                for i, (_, at) in enumerate(level):
                    own = [j - 1 for j in at if j]
                    if own:
                        mean[i, own] = 1 / len(own)
                up, cell = value(mean) @ h, value(mean) @ c
            a = one @ p["x"] + up @ p["h"] + p["b"]
            i, f, o, g = (a.take((slice(None), slice(k * w, (k + 1) * w))) for k in range(4))
            c = f.sigmoid() * cell + i.sigmoid() * g.tanh()
            h = o.sigmoid() * c.tanh()
        return h.take(slice(0, 1)) @ p["out"] + p["out_b"]

    def fit(self, plans: list, goals: np.ndarray) -> list[float]:
        """plans: the levels of each; goals: two numbers for each."""
        goals = np.asarray(goals, float)

        def loss(p, part):
            out = concat([self.root(p, plans[k]) for k in part], 0) - goals[part]
            return (out * out).sum() * (1.0 / len(part))

        return train(self.p, loss, len(plans), self.epochs, batch=8, rate=self.rate, seed=self.seed)

    def predict(self, levels: list) -> np.ndarray:
        return self.root(self.p.opened(), levels).data[0]


#: Models by name, for the registry.
MODELS = {
    "recurrent": Recurrent, "recurrent_whole": lambda k: Recurrent(k, packed=False), "attention": lambda k: Recurrent(k, pool="attention"),
    "chained": Chained, "corrected": Corrected, "embedded": Embedded, "bits": Bits,
}
