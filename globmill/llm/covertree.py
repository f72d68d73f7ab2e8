"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors are set to length 1; cosine >= t is a distance of at most r = sqrt(2 - 2 t). Equal vectors are one class.

The upper part of the tree is fitted on a hash sample of at most SAMPLE vectors: its farthest-first order makes nested
levels with shrinking radii, and as many of its vectors as are needed are the centres of shards. Every vector goes to
its nearest centre; the shards' covering radii come from all vectors, so the sample bounds the driver's part but takes
nothing from exactness. Shards that are near one another lie side by side, and that row is cut into blocks of a bounded
number of bytes (THIRDS of the vectors at most), however large a shard is.

Each block gets a cover tree: nested levels with halving radii, each node with the radius that really covers what is
below it; nodes of a level are farther apart than its radius. They begin at 0.5, as no bound holds above: on the sphere
two nodes of radius 1 may always hold a link. Two blocks meet in a task, where a node goes along only if its ball
reaches a shard of the other block. There, pairs of nodes descend together: one is dropped if the distance of the centres
exceeds both radii and r, all below both are linked at once if distance and radii lie within r, and at the lowest level
the cosines decide. So a dense group costs no enumeration of its pairs. A node of a single vector has radius 0, so its
pairs with others of that kind are dropped by distance alone: within a tree all of them, as they lie apart, and between
trees by a bound on the distance from a quarter of the coordinates, where the rest counts by its length. Cosines in
double precision decide on what is left. A task gives each vector's number of links and its least partner in the task's
own components; sums and the global components follow (see _common.components).

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; shorter
vectors count as filled up with zeros; of repeated rows with one vec_id the usable vector with the least hash counts;
rows without a vec_id are left out; an empty table gives an empty result; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

THRESHOLD = 0.95
#: Vectors that the upper levels are fitted on, bytes of a block's vectors, and parts that the vectors are cut into at least.
SAMPLE, BLOCK_BYTES, THIRDS = 2048, 32 << 20, 3
#: Radii of the levels below a block's root.
LEVELS = (0.5, 0.25, 0.125)
#: Room for rounding in bounds; the cosines themselves are compared as they are.
SLACK, SINGLE = 1e-9, float(np.finfo(np.float32).eps)
#: Numbers of a table of products held at once, and share of pairs left by the first bound above which all coordinates are used.
CELLS, DENSE = 1 << 22, 0.02


def rounding(width: int) -> float:
    """Bound of the error of a single-precision product of two vectors of length 1 (with room to spare)."""
    return 4 * (width + 4) * SINGLE


def reach(threshold: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def filled(vectors: list, width: int, kind: str) -> np.ndarray:
    """Rows of one width, filled up with zeros."""
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    out = x.astype(np.float64)
    top = np.abs(out).max(1, initial=0)[:, None]  # first by the largest component, so that squares stay in range
    out /= np.where(top > 0, top, 1)
    out /= np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]
    return out


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Rows in the order in which each is farthest from those before; a prefix is a net of the radius reached there."""
    order, d = [0], distances(x, x[:1])[:, 0]
    while len(order) < min(most, len(x)) and d.max() > SLACK:
        order.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[order[-1:]])[:, 0])
    return np.array(order)


class CoverTree:
    """Nested levels over the rows of x. centre[l][i]: the centre of row i on level l; the last level is the rows."""

    def __init__(self, x: np.ndarray, centre: list[np.ndarray] | None = None):
        self.x, self.cover, self.rows, n = x, [], [], len(x)
        self.centre = [*(centre if centre is not None else self.levels(x)), np.arange(n)]
        for own in self.centre:
            d = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x, x[own])))
            d[own == np.arange(n)] = 0
            cover = np.zeros(n)
            np.maximum.at(cover, own, d)
            self.cover.append(cover)
            self.rows.append(_groups(own, np.arange(n)))
        # children of each node: the centres of the next level below it
        self.below = [_groups(up[heads := np.unique(down)], heads) for up, down in zip(self.centre, self.centre[1:], strict=False)]
        alone = np.bincount(self.centre[0], minlength=n) if n else np.zeros(0, int)
        self.single, self.fat = np.nonzero(alone == 1)[0], np.nonzero(alone > 1)[0]

    @staticmethod
    def levels(x: np.ndarray) -> list[np.ndarray]:
        out, cells = [], [np.arange(len(x))]
        for radius in LEVELS:
            centre = np.empty(len(x), np.int64)
            for cell in cells:
                centre[cell] = cell if len(cell) == 1 else _net(x, cell, radius)
            out.append(centre)
            cells = list(_groups(centre, np.arange(len(x))).values())
        return out


def _groups(by: np.ndarray, what: np.ndarray) -> dict[int, np.ndarray]:
    if not len(by):
        return {}
    order = np.argsort(by, kind="stable")
    cut = np.nonzero(np.diff(by[order]))[0] + 1
    return {int(by[p[0]]): what[p] for p in np.split(order, cut)}


def _net(x: np.ndarray, cell: np.ndarray, radius: float) -> np.ndarray:
    """Greedy net of a cell, its first row first: for each row a centre within the radius (the radii that count are measured later, in double precision)."""
    y = x[cell].astype(np.float32)
    out, left, least = np.full(len(cell), -1), np.arange(len(cell)), np.float32(1 - radius * radius / 2)
    while len(left):
        # a run of rows picks centres among itself, then what they cover is done
        run = left[:256]
        near = y[run] @ y[run].T >= least
        free, picked = np.ones(len(run), bool), []
        for k in range(len(run)):
            if free[k]:
                picked.append(k)
                free &= ~near[k]
        heads = run[picked]
        own, step = y[heads].T, max(1, CELLS // len(heads))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            cos = y[part] @ own
            top = cos.argmax(1)
            hit = cos[np.arange(len(part)), top] >= least
            out[part[hit]] = cell[heads[top[hit]]]
        out[heads] = cell[heads]
        left = left[out[left] < 0]
    return out


class Links:
    """What a task finds: sums of partners' weights by row, and components."""

    def __init__(self, n: int):
        self.label, self.touched, self.checked = np.arange(n), np.zeros(n, bool), 0

    def join(self, rows: np.ndarray) -> None:
        """All rows are of one component."""
        self.touched[rows] = True
        found = self.label[rows]
        if (found != found[0]).any():
            own = np.unique(found)
            self.label[np.isin(self.label, own)] = own[0]


def dual(a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, threshold: float, same: bool, links: Links, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights that each row of a (and, unless same, of b) is linked with; b's rows are `shift` on in links."""
    r, na, nb = reach(threshold), np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    last, width = len(a.centre) - 1, a.x.shape[1]

    def pairs(level: int, ca: np.ndarray, cb: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(cb)))
        for at in range(0, len(ca), step):
            part = ca[at : at + step]
            if level == last:
                hit = a.x[part] @ b.x[cb].T >= threshold
                links.checked += hit.size
                if same:
                    hit &= part[:, None] != cb[None, :]
                if not hit.any():
                    continue
                na[part] += hit @ wb[cb]
                if not same:
                    nb[cb] += wa[part] @ hit
                for k in np.nonzero(hit.any(1))[0]:
                    links.join(np.r_[part[k], cb[hit[k]] + shift])
                continue
            d = distances(a.x[part], b.x[cb])
            both = a.cover[level][part][:, None] + b.cover[level][cb][None, :]
            for i, j in zip(*np.nonzero(d <= both + r + SLACK), strict=True):
                p, q = int(part[i]), int(cb[j])
                if d[i, j] + both[i, j] <= r - SLACK:
                    x, y = a.rows[level][p], b.rows[level][q]
                    na[x] += wb[y].sum()
                    if same and p == q:
                        na[x] -= wa[x]
                    elif not same:
                        nb[y] += wa[x].sum()
                    links.join(np.r_[x, y + shift]) if len(x) > 1 or p != q or not same else None
                else:
                    pairs(level + 1, a.below[level][p], b.below[level][q])

    def singles() -> None:
        """Nodes of one vector of one tree against those of another."""
        room, m = rounding(width), max(1, width // 4)
        # by variance, so that the first coordinates tell most; the length of the rest bounds its product
        order = np.argsort(-(a.x.var(0) + b.x.var(0)), kind="stable")
        x, y = (t.x[t.single][:, order] for t in (a, b))
        short = lambda z: np.c_[z[:, :m], np.linalg.norm(z[:, m:], axis=1)].astype(np.float32)
        x1, y1, x, y = short(x), short(y), x.astype(np.float32), y.astype(np.float32)
        least, step = np.float32(threshold - room), max(1, CELLS // max(1, len(y)))
        for at in range(0, len(x), step):
            left = x1[at : at + step] @ y1.T >= least
            if np.count_nonzero(left) > DENSE * left.size:
                left = x[at : at + step] @ y.T >= least
            p, q = np.nonzero(left)
            p, q = a.single[at + p], b.single[q]
            for k in range(0, len(p), CELLS // width + 1):
                i, j = p[k : k + CELLS // width + 1], q[k : k + CELLS // width + 1]
                links.checked += len(i)
                hit = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= threshold
                i, j = i[hit], j[hit]
                np.add.at(na, i, wb[j])
                np.add.at(nb, j, wa[i])
                for row, rows in _groups(i, j).items():
                    links.join(np.r_[row, rows + shift])

    if len(a.x) and len(b.x):
        if not same:  # single nodes of one tree are LEVELS[0] apart, which is more than r (see near_duplicates)
            singles()
        # nodes of several: with all of the other side; if same, both orders are met, and counted for the first side
        pairs(0, a.fat, np.r_[b.fat, b.single])
        pairs(0, a.single, b.fat)
    return na, nb


def _usable(e):
    return e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, sample: int = SAMPLE, block: int | None = None, report: dict | None = None
) -> DataFrame:
    """Per vector: key, n_links, component_id, kept.

    block: vectors of a block, where BLOCK_BYTES and THIRDS shall not say it. report gets the number of pairs of vectors
    (met), of those that came into one task (dealt) and of those whose cosine was worked out (checked).
    """
    if reach(threshold) > LEVELS[0] - 1e-3:
        raise ValueError(f"the levels hold for thresholds above {1 - (LEVELS[0] - 1e-3) ** 2 / 2:.4f}")
    kind = "f4" if vectors.schema[embedding].dataType.elementType == T.FloatType() else "f8"
    plain = vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).alias("raw")).where("key is not null")
    base = plain.withColumn("e", F.col("raw").cast("array<double>"))
    base = base.withColumn("e", F.when(F.coalesce(_usable(F.col("e")), F.lit(False)), F.transform("e", lambda x: x + F.lit(0.0))))
    told = base.select("key", "raw", F.size("e").alias("size"), F.when(F.col("e").isNotNull(), F.struct(F.xxhash64("e").alias("a"), F.xxhash64(F.reverse("e"), F.size("e")).alias("b"))).alias("class"))
    hashed = told.groupBy("key").agg(F.min("class").alias("class"))
    owners = hashed.where("class is not null").groupBy("class").agg(F.min("key").alias("id"), F.count("*").alias("w"))
    member = c.stored(hashed.join(owners, "class", "left").select("key", "id", "w", "class"), "cover-member")
    own = member.where("key = id").select("key", "class", "id", "w")
    heads = told.join(own, ["key", "class"]).dropDuplicates(["key"]).select("id", "w", "size", "raw")
    width, n = heads.agg(F.max("size"), F.count("*")).first()
    if not n:
        return member.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    block = block or max(1, min(-(-n // THIRDS), BLOCK_BYTES // (width * int(kind[1]))))
    blocks = -(-n // block)
    picked = heads.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by the parameter
    x = unit(filled([p["raw"] for p in picked], width, kind))
    centres = x[farthest_first(x, min(sample, max(8, 4 * blocks)))]
    centres = centres[_chain(distances(centres, centres))]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = filled(b["raw"].tolist(), width, kind)
            d = distances(unit(v), centres)
            yield pd.DataFrame({"id": b["id"], "w": b["w"], "v": [row.tobytes() for row in v], "shard": d.argmin(1).astype(np.int32), "d": d.min(1)})

    placed = c.stored(heads.select("id", "w", "raw").mapInPandas(assign, "id long, w long, v binary, shard int, d double"), "cover-placed")
    found = {r["shard"]: r for r in placed.groupBy("shard").agg(F.max("d").alias("r"), F.count("*").alias("n")).collect()}  # a row for each centre
    radius = np.array([found[s]["r"] if s in found else -9.0 for s in range(len(centres))])
    count = np.array([found[s]["n"] if s in found else 0 for s in range(len(centres))])
    start, r = np.r_[0, np.cumsum(count)], reach(threshold)
    # shards of each block
    parts = [np.nonzero((start[:-1] < (k + 1) * block) & (start[1:] > k * block) & (count > 0))[0] for k in range(blocks)]

    levels = ", ".join(f"c{k} long" for k in range(len(LEVELS)))
    rows_of = lambda values: unit(np.frombuffer(b"".join(values), kind).reshape(len(values), -1))

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        """A block's tree, and the blocks (its own too) that each node's ball reaches."""
        g = g.sort_values("id").reset_index(drop=True)
        blk, v, ids = int(g["blk"].iloc[0]), rows_of(g["v"]), g["id"].to_numpy()
        tree = CoverTree(v)
        heads_, back = np.unique(tree.centre[0], return_inverse=True)
        can = distances(v[heads_], centres) <= tree.cover[0][heads_][:, None] + radius[None, :] + r + SLACK
        to = np.stack([can[:, p].any(1) for p in parts], 1)
        to[:, blk] = True
        goes = [np.nonzero(row)[0] for row in to]
        return pd.DataFrame({"blk": blk, "id": ids, "w": g["w"], "v": g["v"], "goes": [goes[k] for k in back]} | {f"c{k}": ids[tree.centre[k]] for k in range(len(LEVELS))})

    pick = lambda a: F.element_at(F.array(*map(F.lit, a)), F.col("shard") + 1)
    place = pick(start[:-1].tolist()) + F.pmod(F.xxhash64("id", F.lit(3)), pick(np.maximum(1, count).tolist()))
    grown = placed.withColumn("blk", F.floor(place / F.lit(block)).cast("long"))
    grown = c.stored(grown.groupBy("blk").applyInPandas(grow, f"blk long, id long, w long, v binary, goes array<long>, {levels}"), "cover-trees")
    c.forget(placed)
    tree_columns = ["id", "w", "v", *(f"c{k}" for k in range(len(LEVELS)))]
    dealt = grown.withColumn("to", F.explode("goes")).select(F.least("blk", "to").alias("a"), F.greatest("blk", "to").alias("b"), (F.col("blk") <= F.col("to")).alias("left"), *tree_columns)

    def tree_of(g: pd.DataFrame, v: np.ndarray) -> CoverTree:
        """Nodes come along whole, so the centres are among the rows, which are sorted by id."""
        return CoverTree(v, [np.searchsorted(g["id"].to_numpy(), g[f"c{k}"].to_numpy()) for k in range(len(LEVELS))])

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        same = bool(g["a"].iloc[0] == g["b"].iloc[0])
        g = g.sort_values(["left", "id"], ascending=[False, True]).reset_index(drop=True)
        lefts, n = int(g["left"].sum()), len(g)
        v, w, ids = rows_of(g["v"]), g["w"].to_numpy(), g["id"].to_numpy()
        links = Links(n)
        if same:
            tree = tree_of(g, v)
            sums, _ = dual(tree, tree, w, w, threshold, True, links, 0)
        elif 0 < lefts < n:
            one, two = dual(tree_of(g[:lefts], v[:lefts]), tree_of(g[lefts:], v[lefts:]), w[:lefts], w[lefts:], threshold, False, links, lefts)
            sums = np.r_[one, two]
        else:
            sums = np.zeros(n, np.int64)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, links.label, ids)
        on = links.touched
        met = n * (n - 1) // 2 if same else lefts * (n - lefts)
        # the last row says what the task did
        return pd.DataFrame({"id": pd.array([*ids[on], None], "Int64"), "n": [*sums[on], met], "head": [*least[links.label[on]], links.checked]})

    links = c.stored(dealt.groupBy("a", "b").applyInPandas(compare, "id long, n long, head long"), "cover-links")
    c.forget(grown)
    if report is not None:
        row = links.where("id is null").agg(F.sum("n"), F.sum("head")).first()
        report.update(met=n * (n - 1) // 2, dealt=int(row[0] or 0), checked=int(row[1] or 0))
    links = links.where("id is not null")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    parts_ = c.components(links.select(F.col("id").alias("u"), F.col("head").alias("v")))
    out = member.join(counts, "id", "left").join(parts_.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("key", F.coalesce(F.coalesce("n", F.lit(0)) + F.col("w") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id", "key").alias("component_id"))
    return out.withColumn("kept", F.col("key") == F.col("component_id"))


def _chain(d: np.ndarray) -> list[int]:
    """Rows in an order where each is the nearest to the one before of those left."""
    out, left = [0], np.ones(len(d), bool)
    left[0] = False
    while left.any():
        out.append(int(np.where(left, d[out[-1]], np.inf).argmin()))
        left[out[-1]] = False
    return out


def op3_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")
