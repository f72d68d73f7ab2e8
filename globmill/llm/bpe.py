"""BPE encoding and decoding: speculate and verify.

A greedy longest match proposes each word's tokens. A proposal is right exactly if every two neighbours are
compatible, that is, if merging the two tokens' symbols alone gives these two tokens back; one vectorised pass checks
all pairs of a batch by walking back the merges of both tokens. Only words with an incompatible pair are merged
exactly, in the order of the merges.

Defined results: a null text has no tokens; so has an empty one. Strings of special tokens in a text become those
tokens. Decoding joins the tokens' strings by one blank (the vocabulary file has no decoder); null ids give an empty
text. Rows are independent: repeats, ties and further columns change nothing, and an empty table gives an empty result;
a column that has the name of a new one (`ids`) gives way to it.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

NAME = "word_bpe_49k.json"
#: Words kept with their ids in a Python worker; beyond it the store starts anew.
STORE = 150_000
#: Symbols of a word up to which the least rank is searched in a list.
SHORT = 48

#: Characters for which Python's lower case, NFC (no change) and classes are plain: printable ASCII and Latin letters.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*").fullmatch
_LETTER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+").findall


def byte_letters() -> list[str]:
    """The letter of each byte: itself if it prints, else the next letter from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class WordBpe:
    """The encoder of one vocabulary file with word ends."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {s: np.uint32(i).tobytes() for s, i in special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.strings = strings_of(spec)
        library = Tokenizer.from_str(raw.decode())
        self.normalize, self.pre = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        n = len(self.strings)
        self.base = n
        self.left, self.right, self.order = (np.full(n, -1, np.int64) for _ in range(3))
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge.setdefault((x, y), (rank, z))
            if self.order[z] < 0:
                self.left[z], self.right[z], self.order[z] = x, y, rank
        keys = np.array([x * n + y for x, y in self.merge], np.int64)
        by = np.argsort(keys)
        self.keys, self.ranks = keys[by], np.array([r for r, _ in self.merge.values()], np.int64)[by]
        self.usable = self._reachable()
        self.pairs = {x * n + y: r for (x, y), (r, _) in self.merge.items()}
        self.made = dict(self.merge.values())
        self.longest = max(len(s) - len(self.end) * s.endswith(self.end) for s, i in self.vocab.items())
        self.inner = {s: i for s, i in self.vocab.items() if self.usable[i] and not s.endswith(self.end)}
        self.reach: dict[str, int] = {}  # length of the longest inner token that begins with these two letters
        for t in self.inner:
            if len(t) > self.reach.get(t[:2], 1):
                self.reach[t[:2]] = len(t)
        self.final = {s[: -len(self.end)]: i for s, i in self.vocab.items() if self.usable[i] and s.endswith(self.end) and s != self.end}
        self.store: dict[str, bytes] = {}
        self.mapped: dict[str, bytes] = {}
        self.counts = [0, 0]  # words proposed, words merged exactly

    # --- verification -------------------------------------------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b, or a large number."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of a and b comes before those that build a and b (or before limit).

        Step by step the younger of the two border tokens is taken apart: then the border has the two tokens that met
        there while merges up to that age were done. A merge of them that is older than the one taken apart would
        have come first, across the border.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.astype(np.int64).copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            bad = self._rank(x, y) < most
            good[live[bad]] = False
            ox, oy = self.order[x], self.order[y]
            over = bad | ((ox < 0) & (oy < 0))
            go, x, y, ox, oy = live[~over], x[~over], y[~over], ox[~over], oy[~over]
            # merges run by rank, equal ranks from the left: one across the border starts right of the merge that
            # made a, and left of the one that made b
            first, second = ox > oy, ox <= oy
            a[go[first]], limit[go[first]] = self.right[x[first]], ox[first]
            b[go[second]], limit[go[second]] = self.left[y[second]], oy[second] + 1
            live = go
        return good

    def _reachable(self) -> np.ndarray:
        """Tokens that merging their own symbols gives back."""
        good = np.array([self.order[i] < 0 for i in range(len(self.strings))])
        made = np.nonzero(self.order >= 0)[0]
        fits = np.zeros(len(good), bool)
        fits[made] = self.compatible(self.left[made], self.right[made], self.order[made])
        for i in made[np.argsort(self.order[made])]:
            good[i] = fits[i] and good[self.left[i]] and good[self.right[i]]
        return good

    # --- proposals and exact merging ----------------------------------------------------------------------------

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; word in byte letters, without its end mark."""
        at, n, out, inner, final, longest, reach = 0, len(word), [], self.inner, self.final, self.longest, self.reach.get
        while at < n:
            rest = n - at
            if rest <= longest and (t := final.get(word[at:])) is not None:
                out.append(t)
                break
            for size in range(min(reach(word[at : at + 2], 1), rest - 1), 0, -1):
                if (t := inner.get(word[at : at + size])) is not None:
                    out.append(t)
                    at += size
                    break
        return out

    def exact(self, word: str) -> list[int]:
        """Merge in the order of ranks, leftmost first: a list of ranks for short words, a heap over linked symbols for long ones."""
        ids = [self.vocab[ch] for ch in word[:-1]] + [self.vocab[word[-1] + self.end]]
        n = len(ids)
        if n <= SHORT:
            rank, base, none = self.pairs.get, self.base, len(self.merge) + len(self.vocab)
            ranks = [rank(a * base + b, none) for a, b in zip(ids, ids[1:], strict=False)]
            while ranks and (r := min(ranks)) < none:
                i = ranks.index(r)
                ids[i : i + 2] = [self.made[r]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank(ids[i] * base + ids[i + 1], none)
                if i:
                    ranks[i - 1] = rank(ids[i - 1] * base + ids[i], none)
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i] if ids[i] == x else -1
            if j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [t for t in ids if t >= 0]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words in byte letters, as little-endian unsigned 32-bit integers."""
        parts = [self.propose(w) for w in words]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((t for p in parts for t in p), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(parts)), size)
        inside = np.nonzero(owner[1:] == owner[:-1])[0]
        pairs, back = np.unique(flat[inside] * self.base + flat[inside + 1], return_inverse=True)
        wrong = ~self.compatible(pairs // self.base, pairs % self.base)[back]
        failing = np.unique(owner[inside[wrong]])
        out, ends = flat.astype("<u4"), np.cumsum(size)
        result = [out[e - s : e].tobytes() for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        for i in failing.tolist():
            result[i] = np.array(self.exact(words[i]), "<u4").tobytes()
        self.counts[0] += len(words)
        self.counts[1] += len(failing)
        return result

    # --- texts --------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        if len(self.store) > STORE:
            self.store.clear()
        if len(self.mapped) > STORE:
            self.mapped.clear()
        pieces = []  # per text: (plain?, words) or bytes of a special token
        plain, mapped = set(), set()
        for text in texts:
            own: list = []
            for k, part in enumerate(self.split_special(text) if self.split_special and "<|" in text else [text]):
                if k % 2:
                    own.append(self.special[part])
                elif part:
                    if _PLAIN(part):
                        found = _WORDS(part.lower())
                        plain.update(found)
                        own.append((self.store, found))
                    else:
                        found = [w for w, _ in self.pre(self.normalize(part))]
                        mapped.update(found)
                        own.append((self.mapped, found))
            pieces.append(own)
        if new := [w for w in plain if w not in self.store]:
            letters = self.letters
            self.store.update(zip(new, self.words([w if w.isascii() else "".join([letters[b] for b in w.encode()]) for w in new]), strict=True))
        if new := [w for w in mapped if w not in self.mapped]:
            self.mapped.update(zip(new, self.words(new), strict=True))
        return [b"".join([b"".join([x[0][w] for w in x[1]]) if isinstance(x, tuple) else x for x in own]) for own in pieces]

    def decode(self, ids: bytes) -> str:
        return joined(self.strings, ids)


def strings_of(spec: dict) -> list[str]:
    """Token strings by id."""
    every = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [""] * (1 + max(every.values()))
    for s, i in every.items():
        out[i] = s
    return out


def joined(strings: list[str], ids: bytes) -> str:
    return " ".join(map(strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_OPEN: dict[tuple, object] = {}


def opened(make, shared):
    """One encoder, or list of strings, for each Python worker."""
    if (make, shared.id) not in _OPEN:
        _OPEN[make, shared.id] = make(shared.value)
    return _OPEN[make, shared.id]


def _strings(raw: bytes) -> list[str]:
    return strings_of(json.loads(raw))


def vocabulary(spark: SparkSession, path: str | None = None):
    """Broadcast a vocabulary file (fixed size, about 2 MB), so that executors need no copy of it."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(NAME)
    with open(path, "rb") as f:
        c.small_batches(spark)
        return VocabularyFile(spark.sparkContext.broadcast(f.read()))


class VocabularyFile:
    """A broadcast with a name that tells one from another in a Python worker."""

    def __init__(self, shared):
        self.shared, self.id = shared, shared._jbroadcast.id()

    def __reduce__(self):
        return _vocabulary_file, (self.shared, self.id)

    @property
    def value(self) -> bytes:
        return self.shared.value


def _vocabulary_file(shared, key):
    out = VocabularyFile.__new__(VocabularyFile)
    out.shared, out.id = shared, key
    return out


def encode(text: Column, vocab: VocabularyFile) -> Column:
    """Ids of a text column as binary: little-endian unsigned 32-bit integers, whole texts, no special tokens added."""

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = opened(WordBpe, vocab)
        for texts in batches:
            yield pd.Series(engine.encode(texts.fillna("").tolist()), index=texts.index, dtype=object)

    return encoded(text)


def decode(ids: Column, vocab: VocabularyFile) -> Column:
    """Text of an ids column as encode() makes it; special tokens are kept."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        strings = opened(_strings, vocab)
        for ids in batches:
            yield pd.Series([joined(strings, x or b"") for x in ids], index=ids.index, dtype=object)

    return decoded(ids)


def encode_documents(docs: DataFrame, vocab: VocabularyFile, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with their ids, and the decoded text if a name is given for it."""
    out = docs.withColumn(ids, encode(F.col(text), vocab))
    return out.withColumn(decoded, decode(F.col(ids), vocab)) if decoded else out


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of documents; the digests that the contract names."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, vocabulary(spark), decoded="decoded")
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
