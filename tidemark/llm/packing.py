"""Best-fit packing of token sequences by linear grouping.

1. Every document becomes ids plus an end id; one longer than a sequence is cut into full pieces, of
   which the first takes the rest. Per piece its length and the CRC-32 of its ids are kept.
2. Only the histogram of lengths (at most ``capacity`` rows, whatever the input) goes to the driver.
   There the large lengths, sorted, are split into groups of equal cardinality and rounded up to their
   group's largest; the configurations of these few sizes are optimised as a linear program (column
   generation: a knapsack prices the next configuration); the whole parts of its solution are filled
   with actual lengths group by group, which splits a configuration wherever a length runs out. Large means over 7/16 of a sequence: in trials
   a lower border left more room unfilled, as rounding then wastes what best fit would have used.
3. What rounding left over and all small lengths are put into the tightest room that takes them.
   Bins alike are handled as one entry with a multiplicity, so the plan's size follows the number of
   lengths and configurations, not of documents.
4. A piece finds its place by its rank among pieces of its length: a running count inside its task
   plus an offset of its task. No group of one length meets in one task.

Null texts are empty ones (one end id); rows with a null id are packed too; repeated rows are packed
each; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import byte_letters
from tidemark.llm.common import Scratch, arrow_schema, lean, resolved, slices

#: Fixed value: the word cutter of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 0


class ByteIds:
    """Ids (little-endian unsigned 32-bit) by a vocabulary file of the ``tokenizers`` library (byte-level BPE).

    Merging is done by ``tiktoken``, which gives the same ids at five times the speed.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def text(self, text: str) -> bytes:
        special = self.special if any(t in text for t in self.special) else ()
        return self.bpe.encode_to_numpy(text, allowed_special=set(special), disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


def pieces_of(docs: DataFrame, path: str | Callable[[], str], capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Per piece its place in the document, length and CRC-32; with the task and its rank there by length."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
    arrow = arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        ids_of, seen = byte_ids(resolved(path)), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            for part in slices(batch, 4096, 4 << 20):
                row, piece, start, length, crc, nth = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    data = ids_of.text(text or "") + end
                    n, at, k = len(data) // 4, 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(memoryview(data)[4 * at : 4 * (at + size)]))
                        nth.append(int(seen[size]))
                        seen[size] += 1
                        at, k = at + size, k + 1
                ids = part.column(0).take(pa.array(row, pa.int64()))
                cols = [ids, piece, start, length, crc, [task] * len(row), nth]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 4000) -> list[tuple[float, dict[int, int]]]:
    """The linear program of fewest sequences: how often to use which configuration of the sizes.

    Revised simplex; a new configuration enters as long as an unbounded knapsack over the duals finds
    one worth more than a sequence.
    """
    n = len(sizes)
    size = np.array(sizes)
    columns = [{i: capacity // sizes[i]} for i in range(n)]
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    x = inverse @ np.array(demand, float)
    for _ in range(rounds):
        dual = inverse.sum(0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(min(sizes), capacity + 1):
            fits = size <= room
            worth = np.where(fits, best[room - np.where(fits, size, 0)] + dual, -1.0)
            k = int(worth.argmax())
            if worth[k] > best[room - 1] + 1e-12:
                best[room], choice[room] = worth[k], k
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = Counter(), capacity
        while room > 0:
            if choice[room] < 0:
                room -= 1
                continue
            column[int(choice[room])] += 1
            room -= sizes[choice[room]]
        a = np.zeros(n)
        a[list(column)] = list(column.values())
        d = inverse @ a
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = x - step * d
        x[out] = step
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        columns[out] = dict(column)
    return [(max(0.0, v), c) for v, c in zip(x, columns, strict=True)]


class Rooms:
    """Sequences under way, alike ones together, by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.mask = capacity, {}, 0

    def add(self, room: int, times: int, items: tuple[tuple[int, int], ...]) -> None:
        """``items``: lengths, each with how often it is in a sequence."""
        self.open.setdefault(room, []).append((times, items))
        self.mask |= 1 << room

    def best_fit(self, length: int, n: int) -> None:
        """Puts ``n`` pieces of a length into the tightest rooms; new sequences take the rest."""
        while n:
            fits = self.mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                times, items = self.open[room].pop()
                if not self.open[room]:
                    self.mask &= ~(1 << room)
            else:
                room, times, items = self.capacity, n, ()
            each = room // length
            use = min(times, n // each) or 1
            each = min(each, n)
            if times > use and items:
                self.add(room, times - use, items)
            self.add(room - each * length, use, (*items, (length, each)))
            n -= use * each


def plan(histogram: dict[int, int], capacity: int, groups: int = 128, small: int | None = None) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """How to pack so many pieces of each length: (times, ((length, how often in a sequence), ...)).

    Linear grouping is tried with several borders between large and small lengths, the border at the capacity
    (all lengths are small, so plain best fit) among them, and the plan of the fewest sequences is taken.
    """
    borders = (7 * capacity // 16, capacity // 2, capacity) if small is None else (small,)
    plans = [grouped_plan(histogram, capacity, groups, border) for border in borders]
    return min(plans, key=lambda p: sum(times for times, _ in p))


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """The plan for which lengths over ``small`` are grouped and optimised as configurations."""
    rooms = Rooms(capacity)
    large = sorted(((s, n) for s, n in histogram.items() if small < s < capacity), reverse=True)
    total = sum(n for _, n in large)
    if histogram.get(capacity):
        rooms.add(0, histogram[capacity], ((capacity, 1),))
    left: Counter = Counter({s: n for s, n in histogram.items() if s <= small and s < capacity})
    if total:
        each = -(-total // groups)
        stock: dict[int, list[list[int]]] = {}  # by rounded length: actual lengths and their numbers
        seen, top = 0, 0
        for s, n in large:
            while n:
                top = s if seen % each == 0 else top
                take = min(n, each - seen % each)
                runs = stock.setdefault(top, [])
                if runs and runs[-1][0] == s:
                    runs[-1][1] += take
                else:
                    runs.append([s, take])
                seen, n = seen + take, n - take
        sizes = list(stock)
        for value, column in configurations(sizes, [sum(n for _, n in stock[s]) for s in sizes], capacity):
            times = min([int(value + 1e-6), *(sum(n for _, n in stock[sizes[k]]) // m for k, m in column.items())])
            while times > 0:
                heads = [(stock[sizes[k]], m) for k, m in column.items()]
                use = min(times, max(1, min(runs[0][1] // m for runs, m in heads)))
                items: Counter = Counter()
                for runs, m in heads:
                    need = m * use
                    if runs[0][1] < need:  # the length runs out inside a sequence, so use is 1
                        for _ in range(m):
                            items[runs[0][0]] += 1
                            runs[0][1] -= 1
                            if not runs[0][1]:
                                runs.pop(0)
                        continue
                    items[runs[0][0]] += m
                    runs[0][1] -= need
                    if not runs[0][1]:
                        runs.pop(0)
                rooms.add(capacity - sum(s * m for s, m in items.items()), use, tuple(items.items()))
                times -= use
        for runs in stock.values():
            for s, n in runs:
                left[s] += n
    for s in sorted(left, reverse=True):
        rooms.best_fit(s, left[s])
    return [entry for entries in rooms.open.values() for entry in entries]


class Places:
    """For each length the runs of ranks that go to consecutive sequences at one offset."""

    def __init__(self, packed: list[tuple[int, tuple[tuple[int, int], ...]]], capacity: int):
        rank = np.zeros(capacity + 1, np.int64)
        rows, sequence = [], 0
        for times, items in packed:
            at = 0
            for length, n in items:
                for _ in range(n):
                    rows.append((length, int(rank[length]), sequence, at))
                    rank[length] += times
                    at += length
            sequence += times
        self.sequences = sequence
        runs = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.first, self.base, self.offset = runs[:, 1].copy(), runs[:, 2].copy(), runs[:, 3].copy()
        self.begin = np.searchsorted(runs[:, 0], np.arange(capacity + 2))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            lo, hi = self.begin[length[part[0]]], self.begin[length[part[0]] + 1]
            run = lo + np.searchsorted(self.first[lo:hi], rank[part], side="right") - 1
            sequence[part] = self.base[run] + rank[part] - self.first[run]
            offset[part] = self.offset[run]
        return sequence, offset


def pack(docs: DataFrame, path: str | Callable[[], str], capacity: int = 2048, groups: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(pieces_of(docs, path, capacity, id_col, text_col), "pieces")
    counts = scratch.save(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity, groups), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Tasks times lengths rows: they grow with the input, so they are never broadcast.
    ranked = pieces.join(offsets.hint("merge"), ["task", "length"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("sequence_id")
    )
    schema = T.StructType([*ranked.schema.fields, T.StructField("offset", T.LongType())])
    arrow = arrow_schema(schema)

    def place(batches):
        for b in batches:
            sequence, offset = places.value.of(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.mapInArrow(lean(place), schema)
