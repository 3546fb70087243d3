"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups they form.

1. Equal sets are one class, by two 64-bit sums over the set; its smallest id stands for it.
2. Sets that can be alike share a shingle among their rarest ones (prefix principle): with a threshold of
   3/4 each set offers a quarter of its shingles. The order is by frequency within a fixed share of the
   hash range, then by hash, so a common line or passage is offered only by sets that hold little else.
   One shuffle of that share counts frequencies; a shingle of one document alone is dropped there.
3. Sets under one shingle form a block, led by its smallest id (in a second round, its largest). A set is
   first compared with one lead, the one that it meets in most blocks, so this is linear in the sets; the
   links found merge components, and a large group of near copies is soon one component, its blocks done.
4. Where a block still holds several components, their count vectors go into an R-tree: shingles are
   hashed to groups, a set is the point of its group counts, and the summed minima of two points (or of a
   point and a node's upper corner) bound the overlap. A block gives no pairs: it tells which of its sets
   the bounds connect, a row a set at most. The sets so connected, over all blocks, are a cluster.
5. A cluster's texts come together once. There the tree gives each set's candidates of other components,
   which are verified nearest first; the first that links unites two components and settles all other
   pairs between them, so only uniting links leave a task. A large block or cluster is dealt into cells
   of bounded weight. Nothing is capped, so no link between components is lost.

Links are verified on hashed shingles and then on the words themselves; equal sets are told by the sums.

The count vectors also bound the pairs of step 3 before any set is fetched. The prefix blocks are what
lets the tree be distributed: on random texts of some hundred shingles no small tree separates sets
that share nothing, whereas a block holds only sets with a rare shingle in common.

A null or wordless text has an empty set and is linked with nothing. A row with a null id gets a null
component. Rows that repeat a text are one class. Of rows that repeat an id the longest text (then the
greatest) stands for the document; each row is told its own number of shingles and the document's
component. An empty table gives no rows. Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, Scratch, arrow_schema, lean, slices, spans, spare
from tidemark.llm.words import Texts, mix

#: The share of the hash range in which shingles are ordered by frequency; a prefix takes a quarter.
BAND = int(0.36 * 2**63)
GROUPS = 128
FULL = 65_535  # a group's count is this or more
SMALL_IDS = 1_000_000  # up to so many 64-bit ids may be broadcast
SLICE = 3 << 20  # bytes of text that are hashed at once
BLOCK_ROWS = 4096  # a block with more sets is searched in cells of two such parts
CELL_SHINGLES = 1 << 20  # and so is a cluster with more shingles
WORDS = re.compile(WORD)
LOWER_CASE = {k: k + 32 for k in range(65, 91)}


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles as numbers below 2**63."""
    texts = Texts(column, lower=True)
    grams = texts.sequences(size) >> np.uint64(1)
    for i in range(texts.n):
        n, first = int(texts.words[i]), int(texts.first[i])
        if n >= size:
            yield np.unique(grams[first : first + n - size + 1]).view(np.int64)
        elif n:
            h = np.uint64(n)
            for w in texts.hash[first : first + n]:
                h = mix(np.array([h ^ w], np.uint64))[0]
            yield np.array([h >> np.uint64(1)]).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def probe(n):
    """How many of ``n`` shingles a set offers to be found by."""
    return n - (3 * n + 3) // 4 + 1


def _mapped(docs: DataFrame, schema: str, of_set, size: int) -> DataFrame:
    """Rows from (id, set) of every text, by slices."""
    arrow = arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 8192, SLICE):
                rows = [of_set(i, s) for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), size), strict=True)]
                yield from (pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow) for cols in [list(zip(*rows, strict=True))] if cols)

    return docs.select("id", "text").mapInArrow(lean(run), schema)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Of each document its set's size, sum hashes and group counts, and how many shingles are in the band."""

    def of_set(i, s):
        h1, h2 = sums(s)
        counts = np.minimum(np.bincount(s & (GROUPS - 1), minlength=GROUPS), FULL).astype("<u2").tobytes()
        return i, len(s), int(np.searchsorted(s, BAND)), h1, h2, counts

    return _mapped(docs, "id bigint, n bigint, nb bigint, h1 bigint, h2 bigint, vec binary", of_set, size)


def sums(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set by which equal sets are told."""
    u = s.view(np.uint64)
    return tuple(int(np.sum(mix(u ^ np.uint64(k)), dtype=np.uint64).view(np.int64)) for k in (0x51ED27, 0xC0FFEE11))


def offered(docs: DataFrame, size: int) -> DataFrame:
    """(key, h1): of the set with this sum the shingles of the band, and further ones where the band holds
    fewer than a prefix. Of equal sets in a slice one offers.
    """
    arrow = arrow_schema(T._parse_datatype_string("key bigint, h1 bigint"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 8192, SLICE):
                first = {s.tobytes(): s for s in shingle_sets(part.column(1), size) if len(s)}.values()
                sets = [s[: max(int(np.searchsorted(s, BAND)), probe(len(s)))] for s in first]
                own = np.repeat(np.array([sums(s)[0] for s in first], np.int64), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else [], pa.int64()), pa.array(own)], schema=arrow)

    return docs.select("id", "text").mapInArrow(lean(run), "key bigint, h1 bigint")


def need(a, b):
    """The least overlap of sets of these sizes whose Jaccard similarity is 3/4: 7 * overlap >= 3 * (a + b)."""
    return (3 * (a + b) + 6) // 7


def vectors(column: pa.Array) -> np.ndarray:
    """Count vectors as rows; a group that may hold more than a vector can say counts as endless."""
    first = column.offset
    ends = np.frombuffer(column.buffers()[1], np.int32)[first : first + len(column) + 1]
    out = np.frombuffer(column.buffers()[2], "<u2", (int(ends[-1]) - int(ends[0])) // 2, int(ends[0])).reshape(-1, GROUPS).astype(np.int32)
    out[out == FULL] = 1 << 24
    return out


class CountTree:
    """An R-tree over count vectors, packed by size and then by the widest groups."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 32):
        order = np.argsort(sizes, kind="stable")
        widest = np.argsort(-points.var(0))[:2]
        slab = max(leaf, int(np.ceil(np.sqrt(len(order) / leaf))) * leaf)
        order = np.concatenate([part[np.lexsort((points[part, widest[1]], points[part, widest[0]] // 4))] for part in np.split(order, range(slab, len(order), slab))])
        self.points, self.sizes, self.leaf = points, sizes, leaf
        self.leaves = [order[i : i + leaf] for i in range(0, len(order), leaf)]
        top = np.array([points[g].max(0) for g in self.leaves])
        low, high = np.array([sizes[g].min() for g in self.leaves]), np.array([sizes[g].max() for g in self.leaves])
        self.levels = [(top, low, high)]
        while len(top) > leaf:
            cut = range(0, len(top), leaf)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def search(self, q: int) -> np.ndarray:
        """Numbers of the points that the bounds cannot tell apart from point ``q``."""
        x, n = self.points[q], self.sizes[q]
        live = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            live = live[(4 * high[live] >= 3 * n) & (3 * low[live] <= 4 * n)]
            live = live[np.minimum(top[live], x).sum(1) >= need(n, np.maximum(low[live], -(-3 * n // 4)))]
            if depth:
                live = (live[:, None] * self.leaf + np.arange(self.leaf)).ravel()
                live = live[live < len(self.levels[depth - 1][0])]
        found = np.concatenate([self.leaves[i] for i in live]) if len(live) else np.empty(0, np.int64)
        m = self.sizes[found]
        found = found[4 * np.minimum(m, n) >= 3 * np.maximum(m, n)]
        return found[np.minimum(self.points[found], x).sum(1) >= need(n, self.sizes[found])]


class Rows:
    """Rows of whole blocks, laid end to end, as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.c, self.n, self.comp, self.place, self.before = (batch.column(k).to_numpy() for k in ("c", "n", "comp", "place", "before"))
        self.points = vectors(batch.column(batch.schema.get_field_index("vec")))

    def kept(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of one block may be alike, before their points are looked at.

        Sizes must fit. If the block's shingle is the first that both have, it and what follows it in either
        must be enough. If both have the same shingle just before, they meet in its block and are left to it.
        """
        m, n = self.n[x], self.n[y]
        return (
            (self.comp[x] != self.comp[y])
            & (4 * np.minimum(m, n) >= 3 * np.maximum(m, n))
            & ((self.before[x] != self.before[y]) | (self.before[x] < 0))
            & (1 + np.minimum(m - self.place[x], n - self.place[y]) >= need(m, n))
        )

    def small(self, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of blocks of no more than a leaf or two, where a tree has nothing to skip: all at once."""
        rows = np.repeat(start, size) + spans(size)
        after = np.repeat(start + size, size) - rows - 1
        cuts = np.flatnonzero(np.diff(np.cumsum(after) >> 19)) + 1
        for r, k in zip(np.split(rows, cuts), np.split(after, cuts), strict=True):
            x = np.repeat(r, k)
            y = x + 1 + spans(k)
            keep = self.kept(x, y)
            x, y = x[keep], y[keep]
            for at in range(0, len(x), 1 << 15):
                u, v = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
                fits = np.minimum(self.points[u], self.points[v]).sum(1) >= need(self.n[u], self.n[v])
                yield u[fits], v[fits]

    def large(self, start: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one block by a tree, searched from all but its largest component."""
        own = np.arange(start, start + size)
        names, held = np.unique(self.comp[own], return_counts=True)
        tree = CountTree(self.points[own], self.n[own])
        for q in np.flatnonzero(self.comp[own] != names[held.argmax()]).tolist():
            y = start + tree.search(q)
            x = np.full(len(y), start + q)
            keep = self.kept(x, y)
            yield x[keep], y[keep]


class Forest:
    """Union-find over numbers; the smallest of a set is its name."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def unite(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def in_cells(rows: DataFrame, group: str, weight: str, most: int) -> DataFrame:
    """(id, text, ...) rows with the ``cell`` of their group in which they are compared, one row a cell.

    A group whose weight is bounded is one cell. Of a larger one the largest component is dealt into parts,
    and so are all others together; a part of the one meets a part of the others in a cell, and the others'
    parts meet each other. The largest component need not meet itself, so where it is most of the group, its
    rows are sent once. No cell is heavier than two parts, however large the group is.
    """
    by_comp = rows.groupBy(group, "comp").agg(F.sum(weight).alias("w"))
    whole = by_comp.groupBy(group).agg(F.max(F.struct("w", "comp")).alias("top"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("comps"))
    parts = whole.where("comps > 1").select(group, F.col("top.comp").alias("main"), F.expr(f"top.w div {most} + 1 s"), F.expr(f"(w - top.w) div {most} + 1 t"))
    own = F.expr("transform(sequence(0L, t - 1), j -> pmod(xxhash64(c), s) * t + j)")
    others = F.expr(
        "if(t = 1, sequence(0L, s - 1), concat(transform(sequence(0L, s - 1), i -> i * t + pmod(xxhash64(c), t)),"
        " transform(sequence(0L, t - 1), q -> s * t + least(q, pmod(xxhash64(c), t)) * t + greatest(q, pmod(xxhash64(c), t)))))"
    )
    return rows.join(parts, group).withColumn("cell", F.explode(F.when(F.col("comp") == F.col("main"), own).otherwise(others))).drop("main", "s", "t")


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole cells, out of rows that are sorted by their first two columns."""
    held: list[pa.RecordBatch] = []  # the last cell, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = (batch.column(k).to_numpy() for k in (0, 1))
        change = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        goes_on = bool(held) and (key[0], cell[0]) == (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py())
        if held and not goes_on:
            yield pa.concat_batches(held)
            held = []
        if len(change):
            yield pa.concat_batches([*held, batch.slice(0, int(change[-1]))])
            held = []
        held.append(batch.slice(int(change[-1]) if len(change) else 0))
    if held:
        yield pa.concat_batches(held)


def starts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Where the cells of a batch begin, and their numbers of rows."""
    key, cell = (batch.column(k).to_numpy() for k in (0, 1))
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
    return start, np.diff(np.append(start, len(key)))


def dealt(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    return rows.select(group, "cell", *columns).repartition(F.col(group), F.col("cell")).sortWithinPartitions(group, "cell")


def near_sets(blocks: DataFrame, leaf: int = 64) -> DataFrame:
    """(c, near): the sets that the bounds cannot tell apart from one of another component in their block.

    Sets that such pairs connect inside a block have one ``near``, the least of them, so a row of a block
    gives a row at most, however many pairs there are.
    """

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        start, size = starts_of(batch)
        rows = Rows(batch)
        up = np.arange(len(rows.c))  # the first row that it is connected with, as far as known
        few = size <= leaf

        def pairs():
            yield from rows.small(start[few], size[few])
            for s, k in zip(start[~few].tolist(), size[~few].tolist(), strict=True):
                yield from rows.large(s, k)

        for x, y in pairs():
            while len(x):
                # The higher of two names is hung under the lower one, until all pairs agree.
                a, b = up[x], up[y]
                differ = a != b
                x, y, a, b = x[differ], y[differ], a[differ], b[differ]
                np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
                while True:
                    above = up[up]
                    if (above == up).all():
                        break
                    up = above
        used = np.flatnonzero(np.bincount(up, minlength=len(up))[up] > 1)
        both = np.unique(np.column_stack([rows.c[used], rows.c[up[used]]]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["c", "near"])

    return dealt(blocks, "key", "c", "n", "place", "before", "comp", "vec").mapInArrow(lean(lambda batches: map(near, whole_cells(batches))), "c bigint, near bigint").distinct()


def overlaps(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Common shingles of a set with each of some others (none is empty)."""
    flat = np.concatenate(others)
    hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def spelt(text: str | None, size: int) -> set:
    """A text's shingles as words, for the last look at a pair."""
    words = WORDS.findall(str.translate(text or "", LOWER_CASE))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def alike(s: set, t: set) -> bool:
    return 7 * len(s & t) >= 3 * (len(s) + len(t)) > 0


def tree_links(members: DataFrame, size: int, leaf: int = 64) -> DataFrame:
    """(a, b): links that unite components, out of (cluster, cell, c, n, comp, vec, text), each cell by a tree.

    Pairs are verified where they lie: the nearest by the bound first, until one links, which unites two
    components and settles all pairs between them. So a set gives as many links as components it unites.
    """

    def links(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        for at, n_rows in zip(*(v.tolist() for v in starts_of(batch)), strict=True):
            part = batch.slice(at, n_rows)
            text = part.column(part.schema.get_field_index("text"))
            sets = [s for piece in slices(part.select(["c", "text"]), 8192, SLICE) for s in shingle_sets(piece.column(1), size)]
            c, n, comp = (part.column(k).to_numpy() for k in ("c", "n", "comp"))
            points = vectors(part.column(part.schema.get_field_index("vec")))
            names, held = np.unique(comp, return_counts=True)
            tree = CountTree(points, n) if n_rows > leaf else None
            forest, words = Forest(), {}
            now = comp.copy()  # each row's component by now
            for q in np.flatnonzero(comp != names[held.argmax()]).tolist():
                y = tree.search(q) if tree else np.flatnonzero(4 * np.minimum(n, n[q]) >= 3 * np.maximum(n, n[q]))
                y = y[now[y] != now[q]]
                bound = np.minimum(points[y], points[q]).sum(1)
                slack = bound - need(n[y], n[q])
                y = y[slack >= 0][np.argsort(-slack[slack >= 0], kind="stable")]
                take = 1
                while len(y):
                    some, y, take = y[:take], y[take:], min(256, 4 * take)
                    common = overlaps(sets[q], [sets[i] for i in some.tolist()])
                    for i in some[7 * common >= 3 * (n[q] + n[some])].tolist():
                        if now[i] == now[q]:
                            continue
                        if q not in words:
                            words = {q: spelt(text[q].as_py(), size)}
                        if alike(words[q], spelt(text[i].as_py(), size)):
                            forest.unite(int(now[i]), int(now[q]))
                            now[now == max(now[i], now[q])] = min(now[i], now[q])
                            yield int(c[q]), int(c[i])
                    y = y[now[y] != now[q]]

    def run(batches):
        for batch in whole_cells(batches):
            found = list(links(batch))
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (min, max)], names=["a", "b"])

    return dealt(members, "cluster", "c", "n", "comp", "vec", "text").mapInArrow(lean(run), "a bigint, b bigint")


def some(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among these distinct ids, which are broadcast if they are counted and few."""
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, column, "left_semi")


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The (c, lead) that sizes and summed minima of the count vectors allow."""
    ids = pairs.select("c").union(pairs.select("lead")).distinct()
    own = some(classes.select("c", "n", "vec"), ids, "c")
    lead = own.select(F.col("c").alias("lead"), F.col("n").alias("lead_n"), F.col("vec").alias("lead_vec"))
    both = pairs.join(own, "c").join(lead, "lead").where("4 * least(n, lead_n) >= 3 * greatest(n, lead_n)").select("c", "lead", "n", "lead_n", "vec", "lead_vec")

    def run(batches):
        for x in batches:
            fits = np.minimum(vectors(x.column(4)), vectors(x.column(5))).sum(1) >= need(x.column(2).to_numpy(), x.column(3).to_numpy())
            yield x.select(["c", "lead"]).filter(pa.array(fits))

    return both.mapInArrow(lean(run), "c bigint, lead bigint")


def verified(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Links (a, b) out of (c, lead), a row a ``c``: by hashed shingles, then by the words."""
    few = pairs.count() <= SMALL_IDS
    own = docs.join((F.broadcast(pairs) if few else pairs).withColumnRenamed("c", "id"), "id").select("id", "lead", "text")
    lead = some(docs, pairs.select(F.col("lead").alias("id")).distinct(), "id").select(F.col("id").alias("lead"), F.col("text").alias("lead_text"))

    def run(batches):
        for batch in batches:
            for x in slices(batch, 2048, SLICE, 2):
                a, b, told = x.column(0).to_pylist(), x.column(1).to_pylist(), (None, set())
                # A lead is hashed once a slice; its text is at most about 4/3 of one that it is compared with.
                _, first, which = np.unique(x.column(1).to_numpy(), return_index=True, return_inverse=True)
                leads = list(shingle_sets(x.column(3).take(pa.array(first)), size))
                for k, s in enumerate(shingle_sets(x.column(2), size)):
                    t = leads[which[k]]
                    if 7 * overlaps(s, [t])[0] >= 3 * (len(s) + len(t)):
                        if told[0] != b[k]:
                            told = b[k], spelt(x.column(3)[k].as_py(), size)
                        if alike(spelt(x.column(2)[k].as_py(), size), told[1]):
                            continue
                    a[k] = None
                links = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                yield links.filter(links.column(0).is_valid())

    return own.join(lead, "lead").select("id", "lead", "text", "lead_text").mapInArrow(lean(run), "a bigint, b bigint")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(c, comp): the smallest id that links reach from each linked id, by label propagation with shortcuts."""
    ways = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"ways-{name}")
    labels = scratch.save(ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).select(F.col("a").alias("c"), "comp"), f"labels-{name}-0")
    turn = 0
    while True:
        turn += 1
        near = ways.join(labels.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        moved = labels.join(near, labels["c"] == near["a"]).select("c", "comp", F.least("comp", "near").alias("new"))
        up = labels.select(F.col("c").alias("new"), F.col("comp").alias("beyond"))
        moved = moved.join(up, "new", "left").select("c", F.col("comp").alias("was"), F.coalesce("beyond", "new").alias("comp"))
        moved = scratch.save(moved, f"labels-{name}-{turn}")
        scratch.drop(f"labels-{name}-{turn - 1}")
        labels = moved.select("c", "comp")
        if moved.where("was != comp").isEmpty():
            scratch.drop(f"ways-{name}")
            return labels


def one_text_an_id(rows: DataFrame) -> DataFrame:
    """(id, text) with every id once: of rows that repeat it, the longest text and of those the greatest."""
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    if twice.isEmpty():
        return rows
    chosen = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.max(F.struct(F.length("text").alias("k"), "text")).alias("x"))
    return rows.join(twice, "id", "left_anti").unionByName(chosen.select("id", F.col("x.text").alias("text")))


def groups(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, the size of its set and the smallest id of its component."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    given = rows.where("id is not null")
    known = one_text_an_id(given)
    signed = scratch.save(signatures(rows, size), "signatures")
    own = signed if known is given else scratch.save(signatures(known, size), "own-signatures")
    live = own.where("id is not null and n > 0")
    classes = scratch.save(live.groupBy("h1", "h2").agg(F.min("id").alias("c"), F.first("n").alias("n"), F.first("nb").alias("nb"), F.first("vec").alias("vec")), "classes")
    members = scratch.save(live.select("id", "h1", "h2").join(classes.select("h1", "h2", "c"), ["h1", "h2"]).select("id", "c"), "members")

    by_key = Window.partitionBy("key")
    shared = offered(known, size).withColumn("x", F.min("h1").over(by_key)).withColumn("y", F.max("h1").over(by_key)).where("x != y").select("key", "h1")
    shared = scratch.save(shared.distinct().withColumn("df", F.count(F.lit(1)).over(by_key)), "shared")
    # Different sets with the same first sum would get each other's shingles too: they keep all, in no order.
    twins = classes.groupBy("h1").count().where("count > 1").select("h1", F.lit(True).alias("twin"))
    by_class = Window.partitionBy("h1", "c")
    # One order for all sets: by frequency in the band, beyond it by hash as the shingles are offered.
    order = by_class.orderBy(F.desc("inside"), F.when(F.col("inside"), F.col("df")), "key")
    alone = F.col("nb") - F.sum(F.col("inside").cast("bigint")).over(by_class)  # shingles of one class come first
    # Beyond the band shingles of one class are not counted, so there the place is the least that it can be.
    place = F.row_number().over(order) + F.greatest(alone, F.lit(0))
    front = (
        shared.join(classes.select("h1", "c", "n", "nb"), "h1")
        .join(twins, "h1", "left")
        .withColumn("inside", F.col("key") < BAND)
        .withColumn("place", F.when(F.col("twin"), 1).otherwise(place))
        .where("not inside or place <= n - (3 * n + 3) div 4 + 1")
        .withColumn("before", F.when(F.col("twin"), -1).otherwise(F.coalesce(F.lag("key").over(order), F.lit(-1))))
        .select("key", "c", "n", "place", "before")
    )
    front = scratch.save(front, "front")
    scratch.drop("shared")

    links = None
    comp = members.where("false").select("c", F.col("c").alias("comp"))
    for name, pick in (("least", F.min), ("most", F.max), ("tree", None)):
        open_ = front.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        mixed = open_.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), *([pick(F.struct("c", "n")).alias("lead")] if pick else []))
        mixed = mixed.where("x != y").drop("x", "y")
        if pick:
            # Of the leads of its blocks, a set is compared with the one that it meets most often.
            met = open_.join(mixed, "key").where("c != lead.c and 4 * least(n, lead.n) >= 3 * greatest(n, lead.n)").groupBy("c", F.col("lead.c").alias("lead")).count()
            most = met.groupBy("c").agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("lead"))
            met = scratch.save(most, f"met-{name}")
            pairs = scratch.save(bounded(met, classes), f"pairs-{name}")
            new = scratch.save(verified(pairs, known, size), f"links-{name}")
            scratch.drop(f"met-{name}")
            scratch.drop(f"pairs-{name}")
        else:
            blocks = scratch.save(open_.join(mixed, "key"), "blocks")
            near = scratch.save(near_sets(in_cells(blocks.withColumn("one", F.lit(1)), "key", "one", BLOCK_ROWS).join(classes.select("c", "vec"), "c")), "near")
            scratch.drop("blocks")
            cluster = components(near.select(F.col("c").alias("a"), F.col("near").alias("b")), scratch, "near").withColumnRenamed("comp", "cluster")
            ids = cluster.select("c")
            cluster = cluster.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c")).join(some(classes.select("c", "n", "vec"), ids, "c"), "c")
            texts = some(known.select(F.col("id").alias("c"), "text"), ids, "c")
            new = scratch.save(tree_links(in_cells(cluster, "cluster", "n", CELL_SHINGLES).join(texts, "c"), size), "links-tree")
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        comp = components(links, scratch, name)
    out = signed.select("id", "n").join(members, "id", "left").join(comp, "c", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "c", "id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays.

    Rows with a null id stay; of rows that repeat the same id one with the longest text (then the greatest) stays.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    name = spare(docs, "id")
    grouped = scratch.save(groups(docs, size, id_col, text_col).select(F.col(id_col).alias(name), "component_id").where(F.col(name).isNotNull()), "groups")
    gone = grouped.where(F.col("component_id") != F.col(name)).select(name).distinct()
    few = gone.count() <= SMALL_IDS
    own = F.col(id_col).cast("bigint") == F.col(name)
    left = docs.join(F.broadcast(gone) if few else gone, own, "left_anti")
    twice = grouped.groupBy(name).count().where("count > 1").select(name)
    if twice.isEmpty():
        return left
    again = left.join(twice, own, "left_semi").groupBy(F.col(id_col).cast("bigint").alias(name))
    once = again.agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.length(text_col), text_col)).alias("row"))
    return left.join(twice, own, "left_anti").unionByName(once.select("row.*"))
