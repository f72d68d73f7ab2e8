"""Language ID: language-bitmask n-gram filters.

All languages' Bloom filters lie bit-sliced in one table: the word at a place has a bit for each language, so reading
the places of an n-gram and combining them by AND gives all languages that hold it at once. For each language the
n-grams of a text that it holds are counted; since a filter also claims n-grams it doesn't hold, at a rate that its
fill gives, the counts are corrected by that rate, and the language with the largest corrected count wins.

N-grams are of 2 to 4 characters over the letters of the text in lower case, with one blank for each run of anything
else and at both ends. A language's filter holds its most frequent n-grams that are not far more frequent elsewhere.
They are counted on the labelled rows with the least hashes, SAMPLE documents a language at most; prediction covers all.
HELD is the size of the model: the n-grams of one language's filter.

Defined results: an empty table gives an empty result, repeated rows give a row each; texts that are null or have no letter are `und` with score 0, and so are all if there is nothing to
learn from. Equal counts go to the language that comes first by code point. Extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as c

#: Bound of the training sample (documents of a language) and of the n-grams that a language's filter holds.
SAMPLE, HELD = 1500, 20_000
SIZES = (2, 3, 4)
#: Places of the table (a power of two) and places of an n-gram.
PLACES, PROBES = 1 << 18, 2
#: An n-gram is left out of languages where its rate is below this share of its highest rate, or it is rarer than this.
SHARE, LEAST = 0.2, 3
#: Characters worked on at once.
PIECE = 1 << 20

_LOWER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point: its lower-case letter, or 0."""
    if not _LOWER:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            if (ch := chr(i)).isalpha():
                low = ch.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _LOWER.append(out)
    return _LOWER[0]


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, 0 for each run of others and around each text, and the text of each place."""
    raw = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(r) + 2 for r in raw])
    ends = np.cumsum(size)
    x = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    table = _letters()
    for r, e, s in zip(raw, ends.tolist(), size.tolist(), strict=True):
        x[e - s + 1 : e - 1] = table[r]
    owner = np.repeat(np.arange(len(texts)), size)
    keep = x != 0
    keep[1:] |= (x[1:] == 0) & ((x[:-1] != 0) | (owner[1:] != owner[:-1]))
    keep[:1] = True
    return x[keep], owner[keep]


def hashes(x: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of x."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(x) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the texts' n-grams and the text of each; those of blanks alone and across texts are left out."""
    x, owner = codes(texts)
    longest = max(SIZES)
    for at in range(0, len(x), PIECE):
        y, o = x[at : at + PIECE + longest - 1], owner[at : at + PIECE + longest - 1]
        for n in SIZES:
            m = min(len(y) - n + 1, PIECE)
            if m > 0:
                h = hashes(y[: m + n - 1], n)
                good = (o[:m] == o[n - 1 : n - 1 + m]) & ((y[:m] != 0) | (y[1 : m + 1] != 0))
                yield h[good], o[:m][good]


@dataclass
class Filters:
    """The bit-sliced filters. table: (PLACES, words of 64 languages)."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray  # rate at which a language claims an n-gram it doesn't hold

    @staticmethod
    def places(h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(40)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & np.uint64(PLACES - 1)).astype(np.int64) for k in range(PROBES)]

    @classmethod
    def build(cls, held: dict[str, np.ndarray]) -> Filters:
        languages = sorted(held)
        table = np.zeros((PLACES, max(1, -(-len(languages) // 64))), np.uint64)
        false = np.zeros(len(languages))
        for i, name in enumerate(languages):
            bit = np.uint64(1) << np.uint64(i % 64)
            for at in cls.places(held[name]):
                table[at, i // 64] |= bit
            false[i] = float(((table[:, i // 64] & bit) != 0).mean()) ** PROBES
        return cls(languages, table, false)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and how many of them each language claims."""
        total, claimed = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for h, owner in _grams(texts):
            if not len(h):
                continue
            at = self.places(h)
            cuts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
            who = owner[cuts]
            total[who] += np.diff(np.r_[cuts, len(owner)])
            for word in range(self.table.shape[1]):
                mask = self.table[at[0], word]
                for other in at[1:]:
                    mask = mask & self.table[other, word]
                for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                    bits = (mask >> np.uint64(i % 64)).astype(np.uint8) & 1
                    claimed[who, i] += np.add.reduceat(bits, cuts, dtype=np.int64)
        return total, claimed

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, claimed = self.counts(texts)
        held = np.maximum(0, (claimed - total[:, None] * self.false) / np.maximum(1e-9, 1 - self.false))
        best = held.argmax(1)
        score = np.where(total > 0, held[np.arange(len(texts)), best] / np.maximum(1, total), 0)
        return [self.languages[b] if n > 0 else "und" for b, n in zip(best.tolist(), total.tolist(), strict=True)], np.clip(score, 0, 1)


def learn(docs: DataFrame, bound: int = SAMPLE, held: int = HELD) -> Filters:
    """Filters from the rows with a language and a text in the training folds."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (c.crc_mod(F.col("doc_id"), 4) != 2))
    kept = c.sampled(rows.select("doc_id", "lang", "text"), ["doc_id", "text"], bound, "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in _grams(part["text"].tolist()))]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "h": h.view(np.int64), "n": n.astype(np.int64)})

    grams = kept.select("lang", "text").mapInPandas(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    grams = grams.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy("lang")))
    grams = grams.where(F.col("n") >= LEAST).withColumn("top", F.max("rate").over(W.partitionBy("h"))).where(F.col("rate") >= F.col("top") * SHARE)
    top = grams.withColumn("_nth", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "h"))).where(F.col("_nth") <= held)
    found = top.groupBy("lang").agg(F.collect_list("h").alias("h")).collect()  # at most `held` numbers a language
    return Filters.build({r["lang"]: np.array(sorted(r["h"]), np.int64).view(np.uint64) for r in found})


def predict(text: Column, filters: Filters) -> Column:
    """Struct (lang, score) of a text column."""

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            lang, score = filters.predict(x.where(x.notna(), None).tolist())
            yield pd.DataFrame({"lang": lang, "score": score}, index=x.index)

    return predicted(text)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    filters = learn(docs)
    out = docs.select("doc_id", (c.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), predict(F.col("text"), filters).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
