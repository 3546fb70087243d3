"""Substring dedup with a log-structured fingerprint index.

A window is so many consecutive words; every word goes that a window covers whose words also start
earlier (smaller id, or same text further ahead). To know this of every window, few are looked at:

1. Among the short grams of a window the one with the least hash is its minimizer. Neighbouring windows
   mostly share it, and equal windows always do. All windows in a row with one minimizer are a unit,
   hashed as a whole; a text has a unit for each eight words or so.
2. The index is a log of immutable runs of units: tables bucketed and sorted by minimizer, listed in a
   manifest, so an index can be opened again. A batch of texts, in order of ids, is shuffled to the same
   buckets once and merge-joined with each run as it lies: old runs are never shuffled. A unit that the
   index (or the batch, earlier) holds as it is repeats in whole, so it is settled. The others become a
   new run; where there are more than ``fan_in``, all are compacted into one.
3. Where different units share a minimizer, windows of one may still lie in another. Only of such units
   the texts are read again, and window by window the first place of each is found by an aggregate.

Both the minimizer's and the unit's hash must agree, or both of a window's: 128 bits, whose halves come
from two independent hashes of every word. Copies inside a slice are settled before the shuffle and stay with
their document, so a hot passage sends a row a slice, not a row a document, to its minimizer's task; what a
minimizer gathers there is sorted and spilled, never held.

Null texts are empty: no words, nothing removed. Rows with a null id take no part and keep all words.
Rows that repeat an id with the same text are one document; with another text they are the same
document's further text, of which only earlier starts count. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, arrow_schema, each_slice, lean, shuffle_partitions, spare
from tidemark.llm.words import Texts, least, mix

GRAM = 5
SLICE = 4 << 20  # bytes of text that are hashed at once
UNIT = "mh bigint, uh bigint, id bigint, th bigint, lo int, n int"
SPAN = "id bigint, th bigint, lo int, hi int"
#: So that a batch may be joined by unit where both sides are dealt by minimizer, and a bucket is taken as the sorted file that it is.
AS_IT_LIES = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def units(docs: DataFrame, window: int) -> DataFrame:
    """Of (id, text, th): each unit's minimizer and own hash, its first window and number of windows.

    ``again``: units in a row that repeat earlier units of the slice, as one, without hashes.
    """
    arrow = arrow_schema(T._parse_datatype_string(f"{UNIT}, again boolean"))
    width, bits = window - GRAM + 1, np.uint64((1 << 28) - 1)

    def of_slice(part):
        texts = Texts(part.column(1), twin=True)
        if len(texts.hash) < window:
            return None
        start = np.flatnonzero(texts.whole(window))
        if not len(start):
            return None
        del texts.begin, texts.stop
        gram = texts.sequences(GRAM)
        ranked = gram & ~bits
        ranked |= np.arange(len(gram), dtype=np.uint64)
        at = least(ranked, width)[start]
        del ranked
        at = (at & bits).view(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (texts.text[start[1:]] != texts.text[start[:-1]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(start)))
        lo, hi, at = start[first], start[first + count - 1], at[first]
        mh = gram[at]
        del start, new, gram
        long = texts.sequences(window, twin=True)
        shape = ((at - lo) * 64 + count).astype(np.uint64)
        uh = mix(long[lo] + np.uint64(3) * mix(long[hi] + shape))
        del long
        owner = texts.text[lo]
        ids = part.column(0).to_numpy(zero_copy_only=False)[owner]
        th = part.column(2).to_numpy()[owner]
        place = lo - texts.first[owner]
        del texts
        order = np.lexsort((place, ids, mh, uh))
        s_uh, s_mh, s_id, s_at = uh[order], mh[order], ids[order], place[order]
        same = np.zeros(len(order), bool)
        same[1:] = (s_uh[1:] == s_uh[:-1]) & (s_mh[1:] == s_mh[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        later = same & ((s_id != s_id[head]) | (s_at != s_at[head]))
        again = np.zeros(len(order), bool)
        again[order] = later
        twin = np.zeros(len(order), bool)
        twin[order] = same & ~later
        old = np.flatnonzero(again)  # in order of places, so what overlaps is in a row
        joins = np.zeros(len(old), bool)
        joins[1:] = (owner[old[1:]] == owner[old[:-1]]) & (place[old[1:]] <= (place + count)[old[:-1]] + window - 1)
        begin = np.flatnonzero(~joins)
        end = np.append(begin[1:], len(old))[: len(begin)] - 1
        keep = np.concatenate([np.flatnonzero(~twin & ~again), old[begin]])
        size = np.concatenate([count[~twin & ~again], (place + count)[old[end]] - place[old[begin]]])
        mh, uh = (np.where(again, np.uint64(0), h).view(np.int64) for h in (mh, uh))
        cols = [mh[keep], uh[keep], ids[keep], th[keep], place[keep], size, again[keep]]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches):
        return each_slice(batches, of_slice, 8192, SLICE)

    return docs.select("id", "text", "th").where("id is not null").mapInArrow(lean(run), f"{UNIT}, again boolean")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold while something is planned and run."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class FingerprintIndex:
    """The units seen so far, as bucketed and sorted runs in a shared folder; ``open`` takes up one that was left."""

    def __init__(self, spark: SparkSession, window: int = 20, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.window, self.fan_in = spark, window, fan_in
        self.buckets = buckets or shuffle_partitions(spark)
        self.scratch, self.made = Scratch(spark, "substrings"), 0
        self.runs: dict[str, str] = {}  # name of the run: of its table in the session

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        told = spark.read.json(f"{root}/manifest")
        last = told.orderBy(F.desc("made")).first()
        index = cls(spark, last["window"], last["fan_in"], last["buckets"])
        index.scratch.root, index.made = root, last["made"]
        for name in last["runs"]:
            index._register(name)
        return index

    def _register(self, name: str) -> None:
        table = f"default.tidemark_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} ({UNIT}, fate int) USING parquet CLUSTERED BY (mh) SORTED BY (mh, uh) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.scratch.root}/run-{name}'"
        )
        self.runs[name] = table

    def run(self, name: str) -> DataFrame:
        return self.spark.table(self.runs[name]).where("fate < 2")

    def _write_run(self, rows: DataFrame) -> str:
        """Rows that are dealt by minimizer to as many partitions as there are buckets: a sorted file each."""
        name, self.made = str(self.made), self.made + 1
        table = f"default.tidemark_run_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.scratch.root}/run-{name}")
        writer.bucketBy(self.buckets, "mh").sortBy("mh", "uh").saveAsTable(table)
        self.runs[name] = table
        return name

    def _note(self) -> None:
        row = T.Row(made=self.made, window=self.window, fan_in=self.fan_in, buckets=self.buckets, runs=list(self.runs))
        schema = "made int, window int, fan_in int, buckets int, runs array<string>"
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(f"{self.scratch.root}/manifest")

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.runs.pop(name)}")
        self.scratch.drop(f"run-{name}")

    def close(self) -> None:
        """Frees all runs."""
        for name in list(self.runs):
            self._forget(name)

    def merged(self, fresh: DataFrame) -> DataFrame:
        """New units with their fate: 2 repeats in whole, 1 shares its minimizer with others, 0 does neither."""
        by_unit, by_gram = Window.partitionBy("mh", "uh").orderBy("id", "lo"), Window.partitionBy("mh")
        new = (
            fresh.where("not again").drop("again").repartition(self.buckets, "mh")
            .withColumn("old", F.first(F.struct("id", "lo")).over(by_unit) != F.struct("id", "lo"))
            .withColumn("low", F.min("uh").over(by_gram)).withColumn("high", F.max("uh").over(by_gram))
        )
        for name in self.runs:
            held = self.run(name).select("mh", "uh")
            same = held.distinct().withColumn("held", F.lit(True))
            grams = held.groupBy("mh").agg(F.min("uh").alias("least"), F.max("uh").alias("most"))
            new = new.join(same, ["mh", "uh"], "left").join(grams, "mh", "left").withColumns(
                {"old": F.col("old") | F.coalesce("held", F.lit(False)), "low": F.least("low", "least"), "high": F.greatest("high", "most")}
            ).drop("held", "least", "most")
        fate = F.when(F.col("old"), 2).when(F.col("low") != F.col("high"), 1).otherwise(0)
        return new.select(*[f.split()[0] for f in UNIT.split(", ")], fate.alias("fate"))

    def add(self, docs: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
        """Takes in a batch of (id, text, th) whose ids all follow those of earlier batches.

        Returns (id, th, lo, hi) of the words that whole repeated units cover, and the units of any
        batch whose windows are still to be compared. After the ``last`` batch nothing is kept for others.
        """
        turn = self.made
        fresh = self.scratch.save(units(docs, self.window), f"units-{turn}")
        with settings(self.spark, AS_IT_LIES):
            before = list(self.runs)
            name = self._write_run(self.merged(fresh))
            told = self.spark.table(self.runs[name])
            open_ = told.where("fate = 1").select("id", "th", "lo", "n")
            grams = told.groupBy("mh").agg(F.min("uh").alias("least"), F.max("uh").alias("most"))
            for r in before:  # old units whose minimizer is shared by now
                open_ = open_.unionByName(self.run(r).join(grams, "mh").where("least != uh or most != uh").select("id", "th", "lo", "n"))
            open_ = self.scratch.save(open_, f"open-{turn}")
        whole = fresh.where("again").select("id", "th", "lo", "n").unionByName(told.where("fate = 2").select("id", "th", "lo", "n"))
        spans = self.scratch.save(whole.select("id", "th", "lo", (F.col("lo") + F.col("n") + (self.window - 1)).alias("hi")), f"spans-{turn}")
        self.scratch.drop(f"units-{turn}")
        if last:
            self.close()
        else:
            if len(self.runs) > self.fan_in:
                self.compact()
            self._note()
        return spans, open_

    def compact(self) -> None:
        """Merges all runs into one; of a unit only its first place stays."""
        old = list(self.runs)
        rows = reduce(DataFrame.unionByName, [self.run(r) for r in old])
        rows = rows.repartition(self.buckets, "mh").groupBy("mh", "uh").agg(F.min(F.struct("id", "lo", "th", "n")).alias("x"))
        self._write_run(rows.select("mh", "uh", "x.id", "x.th", "x.lo", "x.n", F.lit(0).alias("fate")))
        for r in old:
            self._forget(r)


def windows_of(docs: DataFrame, window: int) -> DataFrame:
    """Of (id, th, text, units): the hashes of the windows that start in those units."""
    schema = "wh bigint, mh bigint, id bigint, th bigint, lo int"
    arrow = arrow_schema(T._parse_datatype_string(schema))

    def of_slice(part):
        texts = Texts(part.column("text"), twin=True)
        if len(texts.hash) < window:
            return None
        lists = part.column("units")
        items = lists.flatten()
        owner = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
        lo, n = items.field(0).to_numpy().astype(np.int64), items.field(1).to_numpy().astype(np.int64)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, owner = np.repeat(lo, n) + nth, np.repeat(owner, n)
        at = texts.first[owner] + start
        long, half = (texts.sequences(window, twin)[at].view(np.int64) for twin in (False, True))
        cols = [long, half, part.column("id").to_numpy()[owner], part.column("th").to_numpy()[owner], start]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches):
        return each_slice(map(lambda b: b.select(["id", "text", "th", "units"]), batches), of_slice, 8192, SLICE)

    return docs.mapInArrow(lean(run), schema)


def repeated_spans(docs: DataFrame, window: int = 20, batches: int = 4) -> DataFrame:
    """(id, th, spans): the word ranges of (id, text, th) that repeat earlier windows, a row for each text that has any."""
    index = FingerprintIndex(docs.sparkSession, window)
    cuts = docs.approxQuantile("id", [k / batches for k in range(1, batches)], 0.05) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    found = []
    for k in range(len(cuts) + 1):
        batch = docs if not cuts else docs.where((F.col("id") > cuts[k - 1] if k else F.lit(True)) & (F.col("id") <= cuts[k] if k < len(cuts) else F.lit(True)))
        found.append(index.add(batch, last=k == len(cuts)))
    spans, open_ = found[0]
    for s, o in found[1:]:
        spans, open_ = spans.unionByName(s), open_.unionByName(o)
    # Columns of these tables are named here, so what else a table of documents holds cannot clash.
    listed = open_.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "n")).alias("units"))
    compared = index.scratch.save(windows_of(docs.select("id", "th", "text").join(listed, ["id", "th"]), window), "windows")
    heads = compared.groupBy("wh", "mh").agg(F.min(F.struct("id", "lo")).alias("head"), F.max(F.struct("id", "lo")).alias("tail"))
    later = compared.join(heads.where("head != tail"), ["wh", "mh"]).where(F.struct("id", "lo") != F.col("head"))
    spans = spans.unionByName(later.select("id", "th", "lo", (F.col("lo") + window).alias("hi")))
    return spans.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("th"))


def _kept(texts: Texts, i: int, spans: list | None) -> np.ndarray:
    keep = np.ones(int(texts.words[i]), bool)
    for s in spans or ():
        keep[s["lo"] : s["hi"]] = False
    return keep


def _joined(texts: Texts, data: bytes, i: int, keep: np.ndarray) -> bytes:
    w = texts.first[i] + np.flatnonzero(keep)
    return b" ".join([data[a:b] for a, b in zip(texts.begin[w].tolist(), texts.stop[w].tolist(), strict=True)])


def dedup_digest(docs: DataFrame, window: int = 20, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_removed, and the SHA-256 of the words kept, joined by a space."""
    rows = _prepared(docs, id_col, text_col)
    both = rows.join(repeated_spans(rows, window, batches), ["id", "th"], "left").select("id", "text", "spans")
    schema = f"{id_col} bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    arrow = arrow_schema(T._parse_datatype_string(schema))

    def of_slice(part):
        texts = Texts(part.column(1))
        data = texts.data.tobytes()
        removed, digest = [], []
        for i, spans in enumerate(part.column(2).to_pylist()):
            keep = _kept(texts, i, spans)
            removed.append(int((~keep).sum()))
            digest.append(hashlib.sha256(_joined(texts, data, i, keep)).hexdigest())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(texts.words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digest)], schema=arrow)

    def run(parts):
        return each_slice(parts, of_slice, 4096, SLICE)

    return both.mapInArrow(lean(run), schema)


def dedup(docs: DataFrame, window: int = 20, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without what repeats: a text that loses words becomes its kept words joined by a space.

    Texts that lose nothing, and nulls, stay as they are.
    """
    rows = _prepared(docs, id_col, text_col)
    spans = repeated_spans(rows, window, batches)
    name = spare(docs, "th")
    d, s = docs.withColumn(name, F.coalesce(F.xxhash64(text_col), F.lit(0))).alias("d"), spans.alias("s")
    same = (F.col(f"d.`{id_col}`").cast("bigint") == F.col("s.id")) & (F.col(f"d.{name}") == F.col("s.th"))
    both = d.join(s, same, "left").select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("s.spans").alias(spare(docs, "spans")))
    arrow = arrow_schema(docs.schema)
    at = docs.columns.index(text_col)

    def of_slice(part):
        texts = Texts(part.column(at))
        data, out = texts.data.tobytes(), part.column(at).to_pylist()
        for i, found in enumerate(part.column(part.num_columns - 1).to_pylist()):
            if found:
                out[i] = _joined(texts, data, i, _kept(texts, i, found)).decode("utf-8", "replace")
        return pa.RecordBatch.from_arrays([pa.array(out, arrow.field(at).type) if i == at else c for i, c in enumerate(part.columns[:-1])], schema=arrow)

    def run(parts):
        return each_slice(parts, of_slice, 4096, SLICE, at)

    return both.mapInArrow(lean(run), docs.schema)
