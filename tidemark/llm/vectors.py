"""Exact top-k search and approximate nearest neighbours by inner product.

The query set is taken in blocks of bounded size; each block is broadcast once and meets all candidates
where they lie, so candidates are never shuffled and only short lists leave a task. A block's lists are
written before the next block is sent, so plan and broadcasts stay bounded. A task's matrices are tiles of
bounded size.

Vectors that are null or hold a null or non-finite component take no part (nor, in the approximate
search, zero vectors), neither do rows with a null id. Shorter vectors count as filled up with zeros.
Rows that repeat an id are candidates each; as queries they count once, by the greatest vector. Empty tables give no rows; a
query with fewer candidates gets all of them. Ties go to the smaller id. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, lean

BLOCK = 32_768  # queries that are broadcast at once
TILE = 2048
NODES = 4  # groups of components, each with a score list of its own
NONE = np.iinfo(np.int64).max


def usable(df: DataFrame, id_col: str, vec_col: str, zeros: bool = True) -> DataFrame:
    """(id, v) of the vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vec_col)
    out = df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, bad))
    if not zeros:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Best:
    """The best k of each query so far, by score and then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), NONE)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Takes in single (query, id, score) entries."""
        use = score >= self.score[query, -1]
        query, ids, score = query[use], ids[use], score[use]
        if not len(query):
            return
        who = np.unique(query)
        q = np.concatenate([query, np.repeat(who, self.k)])
        i = np.concatenate([ids, self.id[who].ravel()])
        s = np.concatenate([score, self.score[who].ravel()])
        order = np.lexsort((i, ~s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, who)
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        top = nth < self.k
        self.score[who], self.id[who] = s[top].reshape(-1, self.k), i[top].reshape(-1, self.k)

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        q, j = np.nonzero(self.id != NONE)
        return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(self.id[q, j]), pa.array(self.score[q, j])], names=["query_id", "vec_id", "score"])


def query_blocks(rows: DataFrame, is_query: Column | str) -> Iterator[tuple[np.ndarray, list]]:
    """The queries, some ten thousands at a time: ids and vectors."""
    wanted = rows.where(is_query).groupBy("id").agg(F.max("v").alias("v"))
    blocks = max(1, -(-wanted.count() // (BLOCK * 3 // 4)))
    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        got = sorted((r["id"], r["v"]) for r in part.collect())
        if got:
            yield np.array([i for i, _ in got], np.int64), [v for _, v in got]


def padded(vectors: list, dims: int) -> np.ndarray:
    return np.array([np.pad(np.array(v, np.float64), (0, dims - len(v))) for v in vectors])


def kth_scores(lists: DataFrame, ids: np.ndarray, k: int) -> list:
    """Of each query the k-th best score in the lists; None where they are shorter."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    cut = {r["query_id"]: r["score"] for r in lists.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", "score").collect()}
    return [cut.get(i) for i in ids.tolist()]


def exact_scores(q: np.ndarray, c: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products of rows of integers held as doubles, as 64-bit integers.

    ``wide``: a product may pass 2**53 (but not 2**63), so the numbers are split in halves whose products
    doubles hold exactly; what the sum of the parts wraps around it wraps back.
    """
    if not wide:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    (qh, ql), (ch, cl) = ((h, v - h * 65536) for v in (q, c) for h in (np.floor(v / 65536),))
    dot = lambda x, y: np.einsum("ij,ij->i", x, y).astype(np.int64)
    return (dot(qh, ch) << 32) + ((dot(qh, cl) + dot(ql, ch)) << 16) + dot(ql, cl)


def exact_top_k(df: DataFrame, is_query: Column | str, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Of each query the k candidates with the highest inner product of ``floor(scale * x)``, exactly.

    The components are dealt to m nodes; a node has a list of local scores (the inner product over its own
    components) of the candidates in a task. Three phases: (1) each node sends its best local entries, whose
    whole scores give the k-th best so far, a cutoff tau that no true answer is below. (2) The uniform threshold
    T = tau / m is broadcast: a candidate that reaches tau has a local score of T or more at some node. Each
    node collects the entries that reach T; where its norms say that no entry of a tile can, the tile is not
    multiplied. (3) Only candidates that some node has collected have their remaining scores resolved.

    Scores are exact up to 2**63; OverflowError is raised where a score might not fit a long.
    """
    return _exact_top_k(df, is_query, k, scale, id_col, vec_col)[0]


def _exact_top_k(df: DataFrame, is_query: Column | str, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding"):
    """As ``exact_top_k``; also how many pairs of query and candidate there were and how many were resolved."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    name = "query_id bigint, vec_id bigint, score bigint"
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") * scale, F.lit(2.0)))
    dims, most = rows.agg(F.max(F.size("v")), F.max(square)).first()
    dims, longest = dims or 0, (most or 0.0) ** 0.5 + (dims or 0) ** 0.5 + 1  # floor moves a component by less than 1
    if longest**2 >= 2.0**63:
        raise OverflowError("scores of such vectors may not fit a long")
    wide = longest**2 >= 2.0**53
    cuts = [(i * dims // NODES, (i + 1) * dims // NODES) for i in range(NODES)]
    cuts = [(a, b) for a, b in cuts if a < b]
    pairs, resolved = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    scratch, blocks = Scratch(spark, "top-k"), []

    def tiles(batches, names):
        """(first query, ids, vectors) of tiles; candidates go by their norms, so that small ones lie together."""
        for batch in batches:
            c_ids, c = batch.column(0).to_numpy(), np.floor(scale * matrix(batch.column(1), dims))
            order = np.argsort(-(c**2).sum(1), kind="stable")
            c_ids, c = c_ids[order], c[order]
            for c0 in range(0, len(c), TILE):
                for at in range(0, len(names), TILE):
                    yield at, c_ids[c0 : c0 + TILE], c[c0 : c0 + TILE]

    for n, (ids, vectors) in enumerate(query_blocks(rows, is_query)):
        packed = spark.sparkContext.broadcast((ids, np.floor(scale * padded(vectors, dims))))

        def gather(batches, packed=packed):
            names, q = packed.value
            best = Best(len(names), k)
            for at, c_ids, c in tiles(batches, names):
                part = q[at : at + TILE]
                other = names[at : at + TILE, None] != c_ids[None]
                take = min(k, len(c))
                for a, b in cuts:
                    local = np.where(other, part[:, a:b] @ c[:, a:b].T, -np.inf)
                    pick = np.argpartition(-local, take - 1, axis=1)[:, :take].ravel()
                    who = np.repeat(np.arange(len(part)), take)
                    real = other[who, pick]
                    who, pick = who[real], pick[real]
                    entries = np.unique(who * len(c) + pick)
                    who, pick = entries // len(c), entries % len(c)
                    new = ~(best.id[at + who] == c_ids[pick, None]).any(1)
                    who, pick = who[new], pick[new]
                    best.add(at + who, c_ids[pick], exact_scores(part[who], c[pick], wide))
            yield best.rows(names)

        cutoff = spark.sparkContext.broadcast(kth_scores(rows.mapInArrow(lean(gather), name), ids, k))

        def resolve(batches, packed=packed, cutoff=cutoff):
            names, q = packed.value
            best = Best(len(names), k)
            least = np.array([np.iinfo(np.int64).min if s is None else s for s in cutoff.value])
            # Of each query, for its T; a little less where local scores are rounded.
            slack = longest**2 * 1e-12 if wide else 0.0
            tau = np.array([-np.inf if s is None else s - slack for s in cutoff.value])
            q_norms = np.column_stack([np.sqrt((q[:, a:b] ** 2).sum(1)) for a, b in cuts]) if len(cuts) else np.zeros((len(q), 0))
            for at, c_ids, c in tiles(batches, names):
                part, own = q[at : at + TILE], best.score[at : at + TILE, -1]
                low = np.maximum(tau[at : at + TILE], np.where(best.id[at : at + TILE, -1] != NONE, own - slack, -np.inf)) / max(len(cuts), 1)
                hit = np.zeros((len(part), len(c)), bool)
                for (a, b), norm in zip(cuts, q_norms[at : at + TILE].T, strict=True):
                    can = np.flatnonzero(norm * (np.sqrt((c[:, a:b] ** 2).sum(1)).max() * (1 + 1e-9)) >= low)
                    if len(can):
                        hit[can] |= part[can, a:b] @ c[:, a:b].T >= low[can, None]
                if not cuts:
                    hit[:] = True
                hit &= names[at : at + TILE, None] != c_ids[None]
                who, pick = np.nonzero(hit)
                pairs.add(hit.size)
                resolved.add(len(who))
                for cut in range(0, len(who), 1 << 17):
                    w, p = who[cut : cut + (1 << 17)], pick[cut : cut + (1 << 17)]
                    score = exact_scores(part[w], c[p], wide)
                    use = score >= least[at + w]
                    best.add(at + w[use], c_ids[p[use]], score[use])
            yield best.rows(names)

        blocks.append(scratch.save(rows.mapInArrow(lean(resolve), name), f"block-{n}"))
        packed.destroy()
        cutoff.destroy()
    return ranked_rows(united(blocks, spark, name), k), pairs, resolved


def united(blocks: list[DataFrame], spark, name: str) -> DataFrame:
    out = spark.createDataFrame([], name)
    for b in blocks:
        out = b if b is blocks[0] else out.unionByName(b)
    return out


def ranked_rows(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class KdTree:
    """Points split at medians of their widest axis, down to leaves; leaves are told by their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = 128):
        todo, self.leaves = [np.arange(len(points))], []
        while todo:
            part = todo.pop()
            if len(part) <= leaf:
                self.leaves.append(part)
                continue
            x = points[part]
            axis = int((x.max(0) - x.min(0)).argmax())
            order = np.argpartition(x[:, axis], len(part) // 2)
            todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        self.low = np.array([points[p].min(0) for p in self.leaves])
        self.high = np.array([points[p].max(0) for p in self.leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the leaves' boxes."""
        out = np.zeros((len(q), len(self.leaves)))
        for a in range(q.shape[1]):
            gap = np.maximum(self.low[None, :, a] - q[:, None, a], q[:, None, a] - self.high[None, :, a])
            out += np.maximum(gap, 0) ** 2
        return out


def chi_square(dims: int, share: float) -> float:
    """The value that a chi-square variable stays below with this probability (Wilson and Hilferty)."""
    z = NormalDist().inv_cdf(share)
    return dims * (1 - 2 / (9 * dims) + z * (2 / (9 * dims)) ** 0.5) ** 3


class Neighbours:
    """The best of one query among a task's candidates, by projected distance."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.seen = k, np.empty(0), np.empty(0, np.int64), 0

    def kth(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        self.seen += len(ids)
        use = score >= self.kth()
        i, s = np.concatenate([self.id, ids[use]]), np.concatenate([self.score, score[use]])
        order = np.lexsort((i, -s))[: self.k]
        self.id, self.score = i[order], s[order]


def near(df: DataFrame, is_query: Column | str, k: int = 20, projections: int = 16, share: float = 0.8, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """Of each query about the k nearest candidates by inner product, and how many candidates were verified.

    A vector gets one component more, so that all have the largest norm; distances then order as inner
    products do. Candidates are projected onto a few random normal directions (2-stable: a squared projected
    distance is the squared distance times a chi-square variable) and a task indexes all of its own in
    kd-trees. Leaves are opened in the order of their projected distance; a point is verified on its whole
    vector as long as it is not further, projected, than the stopping test allows: beyond, a point within the
    k-th distance so far would have shown up closer with probability ``share``. A first round over the nearest
    leaves gives each query a k-th distance over all tasks, so tasks need not find one each.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col, zeros=False)
    name = "query_id bigint, vec_id bigint, score double, verified bigint"
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dims, top = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    scratch, blocks = Scratch(spark, "near"), []
    axes = np.random.default_rng(seed).standard_normal(((dims or 0) + 1, projections))
    stop = chi_square(projections, share)

    def searched(packed, cutoff, leaves: int | None):
        def run(batches):
            names, q = packed.value
            least = [-np.inf if s is None else s for s in cutoff.value] if cutoff else [-np.inf] * len(names)
            seen, base = q @ axes[:-1], (q**2).sum(1) + top
            found = [Neighbours(k) for _ in names]
            for batch in batches:
                c_ids, c = batch.column(0).to_numpy(), matrix(batch.column(1), dims)
                lift = np.sqrt(np.maximum(top - (c**2).sum(1), 0))
                points = np.column_stack([c, lift]) @ axes
                tree = KdTree(points)
                for at in range(0, len(q), 256):
                    boxes = tree.distances(seen[at : at + 256])
                    for i, box in enumerate(boxes, at):
                        order = np.argsort(box, kind="stable")[:leaves]
                        box, mine, opened, step = box[order], found[i], 0, 2
                        while opened < len(order):
                            kth = max(least[i], mine.kth())
                            # A task's own list is filled first, so that no query is left with fewer than there are.
                            reach = stop * max(base[i] - 2 * kth, 0.0) * (1 + 1e-12) if mine.kth() > -np.inf else np.inf
                            if box[opened] > reach:
                                break
                            near_ = np.concatenate([tree.leaves[x] for x in order[opened : opened + step]])
                            opened, step = opened + step, 2 * step
                            gap = ((points[near_] - seen[i]) ** 2).sum(1)
                            near_ = near_[(gap <= reach) & (c_ids[near_] != names[i])]
                            mine.add(c_ids[near_], c[near_] @ q[i])
            q_, i_, s_, n_ = [], [], [], []
            for name_, mine in zip(names.tolist(), found, strict=True):
                q_.append(np.full(len(mine.id), name_))
                i_.append(mine.id)
                s_.append(mine.score)
                n_.append(np.where(np.arange(len(mine.id)) == 0, mine.seen, 0))
            cols = [np.concatenate([np.empty(0, t), *x]) for x, t in ((q_, np.int64), (i_, np.int64), (s_, np.float64), (n_, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "vec_id", "score", "verified"])

        return rows.mapInArrow(lean(run), name)

    for n, (ids, vectors) in enumerate(query_blocks(rows, is_query) if dims else ()):
        packed = spark.sparkContext.broadcast((ids, padded(vectors, dims)))
        cutoff = spark.sparkContext.broadcast(kth_scores(searched(packed, None, 2), ids, k))
        blocks.append(scratch.save(searched(packed, cutoff, None), f"block-{n}"))
        packed.destroy()
        cutoff.destroy()
    found = united(blocks, spark, name).withColumn("verified", F.sum("verified").over(Window.partitionBy("query_id")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
