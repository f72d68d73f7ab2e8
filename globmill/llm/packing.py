"""Token-ID output: best-fit-decreasing packing.

Texts are encoded with a byte-level vocabulary, so that ids hold a text in whole, an end token follows each, documents longer than a sequence are cut into whole sequences
and a rest, and the pieces are packed into sequences of a fixed length: longest first, each into the sequence with the
least room that still holds it. A segment tree over amounts of room finds that one. Each row of the result is a
sequence: its ids as a matrix row (little-endian unsigned 16-bit, padded), the cumulative segment lengths, positions
that start at 0 in each segment, and the documents and offsets of its segments, so that unpack() gives every document
back.

Packing goes on inside a partition, in groups of at most GROUP pieces, so nothing is shuffled and a lost task's rows
come out alike again; a hot source meets in no task. Pieces of sequences that aren't full go on to the next group, a
quarter of a group at most, so only a partition's last sequences may stay far from full.

Defined results: a null or empty text is one end token; an empty table gives no sequence; repeated rows are packed each
and come back each (`rows` numbers them; a null key stays null); further columns are left out. Ids or lengths that don't
fit into 16 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from . import bpe

#: The vocabulary file of ranks and the id that is free in it: it ends a document and fills a sequence up.
NAME, END = "byte_bpe_50k.tiktoken", 50256
#: Tokens of a sequence, and pieces packed together.
LENGTH, GROUP = 2048, 4096
#: Sequences less full than this may wait for the next group's pieces.
FULL = 0.99
SCHEMA = "pack_id long, n_tokens int, n_segments int, doc_ids array<long>, rows array<long>, offsets array<int>, cu_seqlens array<int>, ids binary, positions binary"


class RoomTree:
    """Open sequences by their room. Finds the least room that is enough, in the logarithm of the length."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, number: int) -> None:
        self.open[room].append(number)
        self._add(room, 1)

    def _add(self, room: int, d: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += d
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Room and number of the sequence with the least room >= size, taken out of the tree."""
        at = size + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        number = self.open[room].pop()
        self._add(room, -1)
        return room, number


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Pieces of each sequence, in the order they were put in; equal sizes keep their order."""
    tree, out = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        room, number = found if found else (length, len(out))
        if not found:
            out.append([])
        out[number].append(i)
        tree.put(room - sizes[i], number)
    return out


def pieces(ids: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """A document's ids cut into whole sequences and a rest, with their offsets."""
    for at in range(0, max(1, len(ids)), length):
        yield at, ids[at : at + length]


def sequences(group: list[tuple[int, int, int, np.ndarray]], bins: list[list[int]], length: int, end: int) -> Iterator[dict]:
    """group: document, row, offset, ids of each piece; bins: the pieces of each sequence."""
    for members in bins:
        ids, positions, ends = np.full(length, end, "<u2"), np.zeros(length, "<u2"), [0]
        for i in members:
            x = group[i][3]
            ids[ends[-1] : ends[-1] + len(x)], positions[ends[-1] : ends[-1] + len(x)] = x, np.arange(len(x))
            ends.append(ends[-1] + len(x))
        told = {name: [group[i][k] for i in members] for k, name in enumerate(("doc_ids", "rows", "offsets"))}
        yield {"n_tokens": ends[-1], "n_segments": len(members), **told, "cu_seqlens": ends, "ids": ids.tobytes(), "positions": positions.tobytes()}


def settled(sizes: list[int], bins: list[list[int]], length: int, most: int) -> tuple[list[list[int]], list[int]]:
    """Sequences that are done, and the pieces of the emptiest ones, `most` at most, which go on to the next group."""
    filled = [sum(sizes[i] for i in b) for b in bins]
    open_, left = set(), most
    for k in sorted(range(len(bins)), key=lambda k: (filled[k], k)):
        if filled[k] >= FULL * length or len(bins[k]) > left:
            break
        left -= len(bins[k])
        open_.add(k)
    return [b for k, b in enumerate(bins) if k not in open_], sorted(i for k in open_ for i in bins[k])


def _opened(raw: bytes):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(spark: SparkSession, path: str | None = None) -> bpe.VocabularyFile:
    """Broadcast a file of ranks (fixed size)."""
    import public_tokenizers

    return bpe.vocabulary(spark, path or public_tokenizers.path(NAME))


def encode(text: Column, vocab: bpe.VocabularyFile) -> Column:
    """Ids of whole texts (little-endian unsigned 32-bit); strings of special tokens are ordinary text."""

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = bpe.opened(_opened, vocab).encode_ordinary
        for texts in batches:
            yield pd.Series([np.array(run(t), "<u4").tobytes() if t else b"" for t in texts.fillna("")], index=texts.index, dtype=object)

    return encoded(text)


def decode(ids: bytes, raw: bytes) -> str:
    """Text of ids as unpack() gives them."""
    return _opened(raw).decode(np.frombuffer(ids, "<u2").tolist())


def pack(docs: DataFrame, vocab: bpe.VocabularyFile, key: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP, end: int = END) -> DataFrame:
    """Packed sequences of all documents."""
    if length > 1 << 16 or end >= 1 << 16:
        raise ValueError("ids and positions are 16 bits wide")
    encoded = docs.select(F.col(key).cast("long").alias("key"), encode(F.col(text), vocab).alias("ids"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, n, row, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def rows(part, last):
            nonlocal n
            sizes = [len(p[3]) for p in part]
            bins = best_fit_decreasing(sizes, length)
            bins, rest = (bins, []) if last else settled(sizes, bins, length, len(part) // 4)
            x = pd.DataFrame(list(sequences(part, bins, length, end)))
            x.insert(0, "pack_id", range(base + n, base + n + len(x)))
            n += len(x)
            return x, [part[i] for i in rest]

        for b in batches:
            for k, raw in zip(b["key"], b["ids"], strict=True):
                ids = np.append(np.frombuffer(raw, "<u4"), end)
                if ids.max() >= 1 << 16:
                    raise ValueError("an id needs more than 16 bits")
                held += [(None if pd.isna(k) else int(k), base + row, at, x) for at, x in pieces(ids.astype("<u2"), length)]
                row += 1
                while len(held) >= group:
                    x, rest = rows(held[:group], False)
                    yield x
                    held = rest + held[group:]
        if held:
            yield rows(held, True)[0]

    return encoded.mapInPandas(packed, SCHEMA)


def unpack(packs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of packed sequences, each row of its own: key, ids (little-endian unsigned 16-bit, the end token left out)."""
    seg = packs.select("ids", F.explode(F.arrays_zip("doc_ids", "rows", "offsets", F.slice("cu_seqlens", F.lit(1), F.col("n_segments")).alias("b"), F.slice("cu_seqlens", F.lit(2), F.col("n_segments")).alias("e"))).alias("s"))
    part = seg.select(F.col("s.doc_ids").alias(key), F.col("s.rows").alias("_row"), F.col("s.offsets").alias("at"), F.expr("substring(ids, 2 * s.b + 1, 2 * (s.e - s.b))").alias("x"))
    whole = part.groupBy("_row", key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("l"))
    joined = F.aggregate("l", F.lit(b""), lambda a, s: F.concat(a, s["x"]))
    return whole.select(key, joined.alias("w")).select(key, F.expr("substring(w, 1, length(w) - 2)").alias("ids"))


def write(packs: DataFrame, path: str) -> None:
    """Packed sequences as Parquet: the binary columns are the rows of the id and position matrices."""
    packs.write.parquet(path)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(c.table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(spark))
