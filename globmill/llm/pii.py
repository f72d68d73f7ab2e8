"""PII: a semi-Markov conditional random field beside the base patterns.

Base spans come from the contract's patterns. The field works on regions: runs of chunks (between white space) that
hold a digit or `@`, one blank apart; everywhere else nothing can be personal data of these kinds, so regions are
independent of each other. A region is a row of atoms (letters, digits, one other sign). A candidate segment is a run
of at most ATOMS atoms; features of the whole span (counts, shape, check digit, what stands left and right) score it
for each kind, and dynamic programming over the bounded segments chooses boundaries and kinds together. The field is
trained by its likelihood on regions of the documents, the base spans being the truth, where they don't contradict each
other; it then also finds what the patterns miss: numbers that run into one another, or forms with a part missing.

Training regions come from at most SAMPLE different texts with digits or `@`, those with the least hashes; every text
is scanned whole.

Defined results: null texts are empty and have no spans; an empty table gives an empty result; repeated rows give a row
each; extra columns are not used, but by redact(), which leaves them as they are. Added spans never overlap a base span or one another. Equal
texts have equal spans; redact() leaves null as null, and other columns as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

# Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
#: Bounds: documents that regions are taken from, regions learned from, atoms of a segment, passes.
SAMPLE, REGIONS, ATOMS, PASSES, RATE = 600, 500, 16, 30, 0.25
#: Atoms whose segments are scored at once: a long region's memory is that of its atoms alone.
STRETCH = 1024

_CLASS = "A-Za-z0-9._%+-"
_LEFT = re.compile(f"[{_CLASS}]*").fullmatch
_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]").search
_CHUNK = re.compile(r"\S+")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_NOT_DIGIT = re.compile("[^0-9]+")
_WORDCHAR = re.compile(f"[{_CLASS}]")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches: what stands before an `@` begins at the start of its run of signs, but not inside the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _WORDCHAR.match(text, start - 1):
            start -= 1
        if start < at and (m := _RIGHT(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    if not text or not _TRIGGER(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# --- regions, segments, features ------------------------------------------------------------------------------------


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of chunks with a digit or `@`, one white space apart."""
    begin = end = -1
    for m in _CHUNK.finditer(text):
        if _TRIGGER(m[0]):
            if begin >= 0 and m.start() == end + 1:
                end = m.end()
            else:
                if begin >= 0:
                    yield begin, end
                begin, end = m.start(), m.end()
    if begin >= 0:
        yield begin, end


FEATURES = 24


def features(text: str, a: int, b: int) -> list[int]:
    """Numbers of the features that a span has."""
    s = text[a:b]
    d = _NOT_DIGIT.sub("", s)
    n = len(d)
    left, right = text[a - 1 : a], text[b : b + 1]
    out = [0]
    if "@" in s:
        k = s.index("@")
        out += [1] if s.count("@") == 1 and _LEFT(s[:k]) and k and (m := _RIGHT(s, k + 1)) and m.end() == len(s) else [2]
    elif s[0] == "+":
        out += [3 if 10 <= n <= 15 else 4]
    if "@" not in s and any(ch.isalpha() for ch in s):
        out.append(5)
    dots = s.count(".")
    if dots == 3 and n == len(s) - 3 and (p := s.split(".")) and all(x and _small(x) for x in p):
        out.append(6)
    elif dots and "@" not in s:
        out.append(7)
    if n == len(s) - s.count(" ") - s.count("-"):
        if 14 <= n <= 19:
            out.append(8 if luhn(d) else 9)
            if n == 16:
                out.append(10)
        elif n > 19:
            out.append(11)
        elif n < 10:
            out.append(12)
    if "(" in s and ")" in s and 10 <= n <= 15:
        out.append(13)
    if not s[-1].isalnum():
        out.append(14)
    if not (s[0].isalnum() or s[0] in "+("):
        out.append(15)
    if left and (left.isalnum() or left == "@"):
        out.append(16)
    elif left and left in "._%+-":
        out.append(17)
    if right and (right.isalnum() or right == "@"):
        out.append(18)
    elif right and right in ".-" and text[b + 1 : b + 2].isalnum():
        out.append(19)
    if n == 0:
        out.append(20)
    if " " in s or "\t" in s or "\n" in s:
        out.append(21)
    if s.count("-") > 3 or s.count(" ") > 3:
        out.append(22)
    if "@" not in s and not s[0] == "+" and 10 <= n <= 13 and len(s) - n <= 6:
        out.append(23)
    return out


class Region:
    """Atoms of a region. Its candidate segments (first atom, atom after the last, features) are held at once only where the region is learned from."""

    def __init__(self, text: str, begin: int, end: int, whole: bool = True):
        self.text = text
        self.cuts = array("q", (m.start() for m in _ATOM.finditer(text, begin, end)))
        self.cuts.append(end)
        self.n = len(self.cuts) - 1
        if whole:
            self.first, self.after, self.x = self.segments(0, self.n)

    def segments(self, low: int, high: int) -> tuple[list[int], list[int], np.ndarray]:
        """Candidates whose last atom is one of low .. high - 1."""
        text, cuts, first, after, rows = self.text, self.cuts, [], [], []
        for j in range(low + 1, high + 1):
            if not text[cuts[j] - 1].isalnum():
                continue
            for i in range(max(0, j - ATOMS), j):
                ch = text[cuts[i]]
                if (ch.isalnum() or ch in "+(") and _TRIGGER(text, cuts[i], cuts[j]):
                    first.append(i)
                    after.append(j)
                    rows.append(features(text, cuts[i], cuts[j]))
        x = np.zeros((len(rows), FEATURES))
        for k, row in enumerate(rows):
            x[k, row] = 1
        return first, after, x


# A field is its weights: (kinds, FEATURES). An atom outside of all segments scores 0.


def forward(r: Region, scores: np.ndarray) -> np.ndarray:
    """Log sums of all segmentations of the first j atoms; scores: (segments, kinds)."""
    each = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    alpha, k = [0.0], 0
    for j in range(1, r.n + 1):
        parts = [alpha[j - 1]]
        while k < len(r.after) and r.after[k] == j:
            parts.append(alpha[r.first[k]] + each[k])
            k += 1
        top = max(parts)
        alpha.append(top + np.log(sum(np.exp(p - top) for p in parts)) if len(parts) > 1 else top)
    return np.array(alpha)


def backward(r: Region, scores: np.ndarray) -> np.ndarray:
    each = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
    from_here: list[list[int]] = [[] for _ in range(r.n + 1)]
    for k, i in enumerate(r.first):
        from_here[i].append(k)
    beta = [0.0] * (r.n + 1)
    for i in range(r.n - 1, -1, -1):
        parts = [beta[i + 1], *(each[k] + beta[r.after[k]] for k in from_here[i])]
        top = max(parts)
        beta[i] = top + np.log(sum(np.exp(p - top) for p in parts)) if len(parts) > 1 else top
    return np.array(beta)


def best(r: Region, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's segments: (start, kind, end) in the text. Segments are scored a stretch of atoms at a time."""
    value, back, kinds = array("d", [0.0]), array("q", [-1]), array("b", [0])
    for low in range(0, r.n, STRETCH):
        first, after, x = r.segments(low, min(r.n, low + STRETCH))
        scores = x @ weights.T
        kind, top = (scores.argmax(1).tolist(), scores.max(1).tolist()) if first else ([], [])
        k = 0
        for j in range(low + 1, min(r.n, low + STRETCH) + 1):
            v, b, own = value[j - 1], -1, 0
            while k < len(after) and after[k] == j:
                if (w := value[first[k]] + top[k]) > v:
                    v, b, own = w, first[k], kind[k]
                k += 1
            value.append(v)
            back.append(b)
            kinds.append(own)
    out, j = [], r.n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append((r.cuts[back[j]], kinds[j], r.cuts[j]))
            j = back[j]
    return out[::-1]


def train(texts: list[str], most: int = REGIONS, passes: int = PASSES) -> np.ndarray | None:
    """Weights that make the base spans likely. Regions whose base spans overlap or cut atoms are left out."""
    found: list[tuple[Region, list[tuple[int, int]]]] = []
    empty = 0
    for text in texts:
        spans = base_spans(text)
        for begin, end in regions(text):
            own = [s for s in spans if begin <= s[0] < end]
            if not own and empty > most // 2 or len(found) >= most or end - begin > 400:
                continue
            r = Region(text, begin, end)
            at = {(r.cuts[i], r.cuts[j]): k for k, (i, j) in enumerate(zip(r.first, r.after, strict=True))}
            if any(s[2] > t[0] for s, t in zip(own, own[1:], strict=False)) or any((s[0], s[2]) not in at for s in own):
                continue
            empty += not own
            found.append((r, [(at[s[0], s[2]], s[1]) for s in own]))
    if not any(gold for _, gold in found):
        return None
    w = np.zeros((len(KINDS), FEATURES))
    w[:, 0] = -2
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, passes + 1):
        grad = -0.02 * w
        for r, gold in found:
            if not len(r.x):
                continue
            scores = r.x @ w.T
            alpha, beta = forward(r, scores), backward(r, scores)
            p = np.exp(alpha[r.first][:, None] + scores + beta[r.after][:, None] - alpha[-1])
            grad -= p.T @ r.x
            for k, kind in gold:
                grad[kind] += r.x[k]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w


def _apart(found: list[tuple[int, int, int]], near: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the found spans (in order) that overlap none of the others, which are sorted by start and may overlap one another."""
    out, k, reach = [], 0, -1
    for s in found:
        while k < len(near) and near[k][0] < s[2]:
            reach = max(reach, near[k][2])
            k += 1
        if reach <= s[0]:
            out.append(s)
    return out


def find(text: str | None, weights: np.ndarray | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans."""
    base = base_spans(text)
    if weights is None or not text or not _TRIGGER(text):
        return base, base
    # spans of one kind don't overlap, so those near a region are a run of each kind's list
    more, lists, at = [], [[s for s in base if s[1] == k] for k in range(len(KINDS))], [0] * len(KINDS)
    for begin, end in regions(text):
        near = []
        for k, own in enumerate(lists):
            while at[k] < len(own) and own[at[k]][2] <= begin:
                at[k] += 1
            i = at[k]
            while i < len(own) and own[i][0] < end:
                near.append(own[i])
                i += 1
        if any(s[0] <= begin and s[2] >= end for s in near):
            continue  # a base span is the whole region
        more += _apart(best(Region(text, begin, end, whole=False), weights), sorted(near))
    return base, sorted(base + more)


def training_texts(docs: DataFrame, text: str = "text", bound: int = SAMPLE) -> list[str]:
    """Different whole texts with a digit or `@`, at most `bound`: those with the least hashes."""
    x = docs.select(F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]"))
    return sorted(r["t"] for r in c.sampled(x, ["t"], bound).collect())


def learned(docs: DataFrame, text: str = "text") -> np.ndarray | None:
    weights = train(training_texts(docs, text))
    c.give_back()
    return weights


def spans(text: Column, weights: np.ndarray | None) -> Column:
    """Struct (base, spans) of arrays of (start, end, kind); end exclusive, in code points, sorted by start and kind."""
    one = "array<struct<start:int,kind:int,end:int>>"

    @F.pandas_udf(f"base {one}, spans {one}")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]
        for x in batches:
            got = [find(t, weights) for t in x.where(x.notna(), None)]
            yield pd.DataFrame({"base": [rows(b) for b, _ in got], "spans": [rows(s) for _, s in got]}, index=x.index)

    return found(text)


def _told(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, weights: np.ndarray | None) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([replace(t, find(t, weights)[1]) if isinstance(t, str) else None for t in x], index=x.index, dtype=object)

    return redacted(text)


def replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, last = [], 0
    for a, k, b in spans:
        if a >= last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    x = docs.select("doc_id", spans(F.col("text"), learned(docs)).alias("f")).select("doc_id", F.col("f.base").alias("base"), F.col("f.spans").alias("all"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    count = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return x.select("doc_id", *count, F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"), _told(F.col("all")).alias("spans"))
