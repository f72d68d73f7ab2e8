"""MinHash near-dedup: universal hash minima, banding, verification, components by large-star and small-star.

1. One pass over the texts gives each its shingle set's size, a hash of its word sequence and its signature: BANDS *
   ROWS minima of multiply-add hashes over the distinct shingles. Texts with the same word sequence are one class,
   represented by its least document. At the threshold 0.8, a pair shares no band with probability
   (1 - 0.8^5)^30 = 7e-6.
2. In each bucket (band and key), every member is compared with the bucket's least member: those pairs grow with the
   members only. Agreeing bytes of two signatures tell pairs far below the threshold; all others are verified on the
   full shingle sets. The verified links' components are found.
3. Buckets may still hold members of several components. There, the members outside the bucket's largest component
   (strays) are compared with all members of other components, in blocks of bounded size that are spread over tasks. A
   first pass compares signatures and keeps the members that have any partner left; a second one gets those members'
   full sets, verifies all pairs that are left, each in the first band that it shares, and gives only as many links as
   join components. So no pair that shares a bucket and could join two components is left out, and no group is
   expanded into its pairs.

Defined results: a text that is null or has no words has no shingles and is alone; one with fewer words than a shingle
has its whole sequence as one shingle. Ties fall into one class; every row gives a row, so repeated rows are repeated;
rows that share a key but not the text are one document that links by each of its texts. A row without a key links with
nothing by name: its component is the least key of its class, null (and kept) if there is none. An empty table gives an
empty result; extra columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Words of a shingle and similarity in percent, unless a contract says otherwise.
WORDS, PERCENT = 5, 80
BANDS, ROWS, SEED = 30, 5, 11
#: Share of agreeing signature bytes below which a pair is left unverified: at similarity 0.8 and 150 bytes, 4.6 standard deviations below the mean.
AGREE = 0.65
#: Rows of a block when members of a bucket are compared, and shingles of their sets (a longer document is a block of its own).
STRAYS, MEMBERS = 512, 4096
STRAY_SHINGLES, MEMBER_SHINGLES = 1 << 19, 1 << 21
#: A class of equal texts that holds one in HOT rows is joined by broadcast: there are HOT such classes at most.
HOT = 1000
#: About how many rows of small buckets are compared in one call.
GROUP = 2000
#: Shingles hashed at once; longer documents are hashed piece by piece.
PIECE = 4096

_GAP = re.compile(r"[\x20\x09-\x0D]+")
_UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the n-word shingles of a text, sorted."""

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Shingler(n)
        for x in batches:
            yield pd.Series([own(t) for t in x], index=x.index, dtype=object)

    return hashed(text)


class Shingler:
    """Hashes of shingles; keeps the hashes of words seen."""

    def __init__(self, n: int, store: int = 200_000):
        self.n, self.store, self.seen = n, store, {}

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        return [w for w in _GAP.split(text.lower() if text.isascii() else text.translate(_UPPER)) if w]

    def __call__(self, text: str | None) -> np.ndarray:
        return self.set_of(self.words(text))

    def set_of(self, found: list[str]) -> np.ndarray:
        """Sorted distinct hashes of the shingles of a word sequence."""
        import xxhash

        if not found:
            return np.zeros(0, np.int64)
        if len(self.seen) > self.store:
            self.seen.clear()
        seen = self.seen
        for w in set(found).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        x = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
        n = min(self.n, len(x))
        out = np.full(len(x) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
        return np.unique(out.view(np.int64))


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def minima(x: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each hash function a * s + b (mod 2^64, upper half) its least value over the shingles."""
    a, b = family
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    x = x.view(np.uint64)
    for at in range(0, len(x), PIECE):
        h = np.multiply.outer(a, x[at : at + PIECE])
        h += b[:, None]
        out = np.minimum(out, h.view(np.uint32)[:, 1::2].min(1))
    return out


def signatures(text: Column, n: int) -> Column:
    """Struct: size (of the shingle set), near (a byte of each minimum), keys (of the bands), class (hash of the words); null but for size without words."""

    @F.pandas_udf("size long, near binary, keys array<long>, class binary")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        own, family = Shingler(n), _family(BANDS * ROWS)
        mix = np.random.default_rng(SEED + 1).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for x in batches:
            rows = []
            for t in x:
                words = own.words(t)
                if not words:
                    rows.append((0, None, None, None))
                    continue
                s = own.set_of(words)
                m = minima(s, family)
                keys = (m.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * mix
                keys ^= keys >> np.uint64(31)
                rows.append((len(s), m.astype(np.uint8).tobytes(), keys.sum(1, dtype=np.uint64).view(np.int64), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame(rows, columns=["size", "near", "keys", "class"], index=x.index)

    return signed(text)


def _agree(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (u, v) whose signatures agree enough."""

    @F.pandas_udf("boolean")
    def enough(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).mean(1) >= AGREE)

    one, two = near.select(F.col("id").alias("u"), F.col("near").alias("_a")), near.select(F.col("id").alias("v"), F.col("near").alias("_b"))
    return pairs.join(one, "u").join(two, "v").where(enough("_a", "_b")).select("u", "v")


def _sets(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Shingle sets (id, _set) of some documents. The list of ids grows with the input: it is never broadcast."""
    return texts.join(ids.hint("merge"), "id", "left_semi").select("id", shingles(F.col("text"), n).alias("_set"))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (u, v) that reach the similarity on their full sets. texts: id, text."""
    ids = pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).distinct()
    sets = _sets(texts, ids, n)
    one, two = sets.select(F.col("id").alias("u"), F.col("_set").alias("_a")), sets.select(F.col("id").alias("v"), F.col("_set").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(one, "u").join(two, "v").where(100 * both >= percent * (F.size("_a") + F.size("_b") - both)).select("u", "v")


def _blocks(x: DataFrame, what: str) -> DataFrame:
    """Deal the members of mixed buckets to groups (slot, i, j): strays to blocks i, all members to blocks j.

    x: band, key, id, component, size. Strays go to every j and members to every i, so a bucket has about STRAYS and MEMBERS
    rows, and as many shingles as are stated, in a group at most, however large it is. Small buckets share groups of about
    GROUP rows.
    """
    counts = x.groupBy("band", "key", "component").agg(F.count("*").alias("_n"), F.sum("size").alias("_t"))
    mixed = counts.groupBy("band", "key").agg(F.count("*").alias("_parts"), F.sum("_n").alias("_all"), F.sum("_t").alias("_size"), F.max(F.struct("_n", "component", "_t")).alias("_most")).where("_parts > 1")
    mixed = c.stored(mixed.select("band", "key", "_all", "_size", F.col("_most._n").alias("_n"), F.col("_most._t").alias("_t"), F.col("_most.component").alias("_component")), f"minhash-{what}")
    slots = max(1, (mixed.agg(F.sum(F.greatest(F.col("_all"), F.col("_size") * GROUP / MEMBER_SHINGLES))).first()[0] or 0) // GROUP)
    x = x.join(mixed, ["band", "key"]).withColumn("stray", F.col("component") != F.col("_component"))
    blocks = lambda rows, size, most, shingles: F.greatest(F.ceil(rows / most), F.ceil(size / shingles))
    x = x.withColumn("_s", blocks(F.col("_all") - F.col("_n"), F.col("_size") - F.col("_t"), STRAYS, STRAY_SHINGLES)).withColumn("_m", blocks(F.col("_all"), F.col("_size"), MEMBERS, MEMBER_SHINGLES))
    deal = lambda n: F.pmod(F.xxhash64("id", "band"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    names = ["band", "key", "id", "component", F.pmod(F.xxhash64("band", "key"), F.lit(int(slots))).alias("slot")]
    left = x.where("stray").select(*names, deal(F.col("_s")).alias("i"), every(F.col("_m")).alias("j"), F.lit(True).alias("stray"))
    right = x.select(*names, every(F.col("_s")).alias("i"), deal(F.col("_m")).alias("j"), F.lit(False).alias("stray"))
    return left.unionAll(right)


def _stack(values: pd.Series) -> np.ndarray:
    first = values.iloc[0]
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1) if isinstance(first, bytes) else np.stack(values.to_numpy())


def _partners(g: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each stray of a group (row) the rows of members of other components whose signature agrees enough, where this band is the first that both share.

    g is sorted by band, key and stray.
    """
    near, keys = _stack(g["near"]), _stack(g["keys"])
    part, band, key, stray = (g[k].to_numpy() for k in ("component", "band", "key", "stray"))
    least = AGREE * near.shape[1]
    cuts = np.r_[0, np.nonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1]))[0] + 1, len(g)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        m = a + int((~stray[a:b]).sum())
        for k in range(m, b):
            hit = a + np.nonzero(part[a:m] != part[k])[0]
            hit = hit[(near[hit] == near[k]).sum(1) >= least]
            hit = hit[(keys[hit] == keys[k]).argmax(1) == band[k]]
            if len(hit):
                yield k, hit


def _rest(buckets: DataFrame, parts: DataFrame, signed: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) that join components within buckets. buckets: band, key, id. parts: node, component."""
    by = ["band", "key", "stray", "id"]

    def promising(g: pd.DataFrame) -> pd.DataFrame:
        g, on = g.sort_values(by).reset_index(drop=True), np.zeros(len(g), bool)
        for k, hit in _partners(g):
            on[k] = on[hit] = True
        return g.loc[on, ["band", "key", "id"]].drop_duplicates()

    def verified(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(by).reset_index(drop=True)
        part, ids, sets = g["component"].tolist(), g["id"].tolist(), [np.asarray(s) for s in g["_set"]]
        label = {x: x for x in part}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        u, v = [], []
        for k, hit in _partners(g):
            a, size = sets[k], np.array([len(sets[h]) for h in hit])
            flat = np.concatenate([sets[h] for h in hit])
            at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
            both = np.add.reduceat((a[at] == flat).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
            for h in hit[100 * both >= percent * (len(a) + size - both)].tolist():
                p, q = find(part[k]), find(part[h])
                if p != q:
                    label[max(p, q)] = min(p, q)
                    u.append(ids[k])
                    v.append(ids[h])
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    told = buckets.join(parts.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", "size", F.coalesce("component", "id").alias("component"))
    told = c.stored(told, "minhash-told")
    group = ["slot", "i", "j"]
    dealt = _blocks(told, "mixed").join(signed, "id")
    kept = c.stored(dealt.groupBy(*group).applyInPandas(promising, "band int, key long, id long").distinct(), "minhash-promising")
    ids = kept.select("id").distinct()
    rich = signed.join(ids, "id", "left_semi").join(_sets(texts, ids, n), "id")
    dealt = _blocks(told.join(kept, ["band", "key", "id"], "left_semi"), "left").join(rich, "id")
    return dealt.groupBy(*group).applyInPandas(verified, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (least key reachable by links), kept (key is the least)."""
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    every = c.stored(base.select("key", signatures(F.col("text"), n).alias("s")).select("key", "s.*"), "minhash-signatures")
    owners = c.stored(every.where("size > 0").groupBy("class").agg(F.min("key").alias("id"), F.count("*").alias("_n")), "minhash-owners")
    member = c.stored(_owned(every, owners), "minhash-member")
    heads = owners.select("id", "class").join(every.withColumnRenamed("key", "id"), ["id", "class"]).dropDuplicates(["id", "class"])
    signed = c.stored(heads.select("id", "size", "near", "keys"), "minhash-heads")
    texts = base.withColumnRenamed("key", "id")
    rows = signed.select("id", "size", F.posexplode("keys").alias("band", "key"))
    least = rows.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # members of buckets with more than one, each with the bucket's least one
    buckets = c.stored(rows.join(least, ["band", "key"]), "minhash-buckets")
    pairs = c.stored(_agree(buckets.where("id > head").select(F.col("head").alias("u"), F.col("id").alias("v")).distinct(), signed), "minhash-pairs")
    links = c.stored(_verified(pairs, texts, n, percent), "minhash-links")
    parts = components(links)
    more = c.stored(_rest(buckets.select("band", "key", "id", "size"), parts, signed, texts, n, percent), "minhash-rest")
    if not more.isEmpty():
        parts = components(links.unionAll(more))
    out = member.join(parts.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("key", F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))


def _owned(every: DataFrame, owners: DataFrame) -> DataFrame:
    """key, id (least key of its class, or its own), size of every row. Classes with many rows are few and joined by broadcast, so none meets in one task."""
    total = every.count()
    names = [F.col("key"), F.coalesce("id", "key").alias("id"), F.col("size")]
    hot = owners.where(F.col("_n") * HOT >= max(total, HOT)).select("class", F.col("id").alias("_hot"))
    # a wordless row has no class: it gets one of its own for the join, as no null key may gather in a task
    x = every.select("key", "size", F.coalesce("class", F.concat(F.lit("-"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary")).alias("class"), F.col("class").isNull().alias("_alone"))
    x = x.join(F.broadcast(hot), "class", "left")
    done = x.where(F.col("_alone") | F.col("_hot").isNotNull()).select("key", F.coalesce("_hot", "key").alias("id"), "size")
    rest = x.where(~F.col("_alone") & F.col("_hot").isNull()).join(owners.where(F.col("_n") * HOT < max(total, HOT)).select("class", "id"), "class", "left")
    return done.unionAll(rest.select(*names))


def components(links: DataFrame) -> DataFrame:
    return c.stored(c.components(links), "minhash-parts")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"), n=2).withColumnRenamed("key", "doc_id")
