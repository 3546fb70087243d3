import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import substrings
from tidemark.llm.substrings import FingerprintIndex, dedup, dedup_digest
from tidemark.llm.words import Texts, least

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept(rows, k):
    first = {}
    for i, t in sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), (i, s))
    for i, t in (r[:2] for r in rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[s : s + k])] < (i, s):
                gone[s : s + k] = [True] * k
        yield i, w, [x for x, g in zip(w, gone, strict=True) if not g]


def plain(rows, k=20):
    return sorted(((i, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()) for i, w, left in kept(rows, k)), key=repr)


def corpus(seed, vocabulary, n=50):
    rng = random.Random(seed)
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(18, 60))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(pool)[rng.randint(0, 4) :] if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(w) if rng.random() > 0.05 else None))
    rows += [(n + k, rows[rng.randrange(n)][1]) for k in range(5)]
    rows += [(n + 5, "a " * 200), (n + 6, "b a " * 100), (n + 7, "é\tü\n" * 60), (n + 8, ""), (None, rows[7][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("batches", "vocabulary"), [(1, "abcdefghijklmnopqrst"), (2, "abcdefghijklmnopqrst"), (6, ["x", "cé", *"abcdefgh"])])
def test_digests_are_those_of_all_windows(spark, batches, vocabulary):
    rows = corpus(batches, list(vocabulary))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, th int").repartition(3)
    assert sorted(map(tuple, dedup_digest(docs, 20, batches).collect()), key=repr) == plain(rows)


def test_texts(spark):
    rows = corpus(9, list("abcdefghijklmnopqrst"))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r.text for r in dedup(docs).collect()}
    for i, w, left in kept(rows, 20):
        if i is not None:
            assert got[i] == (" ".join(left) if len(left) < len(w) else next(t for j, t in rows if j == i))
    assert dedup(docs).columns == docs.columns


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_removed) for r in dedup_digest(docs).collect()) == [(1, 0), (1, 0), (2, 40)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert dedup_digest(docs).count() == 0


def test_compaction_keeps_what_the_runs_knew(spark):
    text = [" ".join(f"d{i}w{k}" for k in range(30)) for i in range(4)]
    index = FingerprintIndex(spark, fan_in=2)
    for i, t in enumerate(text):
        index.add(spark.createDataFrame([(i, t, i)], "id bigint, text string, th bigint"))
    assert len(index.runs) <= 2
    spans, _ = index.add(spark.createDataFrame([(9, text[0] + " " + text[3], 9)], "id bigint, text string, th bigint"), last=True)
    assert spans.agg(F.count("*")).first()[0] > 0


def test_hashes_of_sequences_and_places():
    texts = ["a b  c", None, "x", "\n", "é ü a b"]
    t = Texts(pa.array(texts))
    words = [w for s in texts for w in (s or "").split()]
    assert t.words.tolist() == [3, 0, 1, 0, 4] and len(set(t.hash.tolist())) == len(set(words))
    pairs = t.sequences(2)
    assert pairs[0] == pairs[6] and t.whole(2).tolist() == [True, True, False, False, True, True, True]
    for n in (1, 3, 5, 7):
        assert len(t.sequences(n)) == 8 - n + 1
    assert least(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]


def test_a_reopened_index_takes_a_batch(spark):
    rows = [r for r in corpus(12, list("abcdefghij")) if r[0] is not None]
    texts = sorted({i: t for i, t in rows}.items())
    half = len(texts) // 2
    frame = lambda part: spark.createDataFrame([(i, t, i) for i, t in part], "id bigint, text string, th bigint")
    index = FingerprintIndex(spark)
    index.add(frame(texts[:half]))
    again = FingerprintIndex.open(spark, index.scratch.root)
    assert list(again.runs) == list(index.runs)
    with substrings.settings(spark, substrings.AS_IT_LIES | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = again.merged(substrings.units(frame(texts[half:]), 20))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2 and "Bucketed: true" in plan
    spans, _ = again.add(frame(texts[half:]), last=True)
    covered: dict = {}
    for r in spans.collect():
        covered.setdefault(r.id, set()).update(range(r.lo, r.hi))
    gone = {i: len(w) - len(left) for i, w, left in kept(texts, 20)}
    assert all(len(c) <= gone[i] for i, c in covered.items())
    whole = [i for i, t in texts[half:] if t and len(WORD.findall(t)) >= 20 and any(t == u for _, u in texts[:half])]
    assert all(len(covered[i]) == gone[i] for i in whole)


def test_the_query_compacts_its_runs(spark, monkeypatch):
    calls, compact = [], FingerprintIndex.compact
    monkeypatch.setattr(FingerprintIndex, "compact", lambda self: (calls.append(len(self.runs)), compact(self)))
    rows = [r for r in corpus(13, list("abcdefghijklmnopqrst"), 80) if r[0] is not None]
    got = dedup_digest(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows) and calls


def test_words_that_a_polynomial_takes_for_one(spark):
    odd = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    rows = [(1, " ".join(["w"] * 9 + [odd] + [f"x{k}" for k in range(10)])), (2, " ".join(["w"] * 9 + [odd.translate(str.maketrans("ab", "ba"))] + [f"x{k}" for k in range(10)]))]
    got = dedup_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_columns_with_names_of_our_own(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, "a", "b", 1, 2), (2, text, "c", "d", 3, 4)], "doc_id bigint, text string, th__ string, spans__ string, th int, id int")
    assert sorted(map(tuple, dedup(docs).collect())) == [(1, text, "a", "b", 1, 2), (2, "", "c", "d", 3, 4)]


class Handed:
    """Stands in for documents and gives the function that workers would run."""

    def __getattr__(self, name):
        return lambda *a, **k: self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


@pytest.mark.parametrize("made", [substrings.units, substrings.windows_of])
def test_a_worker_holds_the_arrays_of_one_slice(spark, made):
    """For 4 MB of text: those of a slice are gone before the next is hashed."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=350)) for _ in range(6000)]
    cols = {"id": range(6000), "text": texts, "th": range(6000), "units": [[{"lo": 0, "n": 8}]] * 6000}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})
    run = made(Handed(), 20)
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch, batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 10_000
    assert peak < 72 << 20


def test_a_batch_is_gone_before_the_next_is_read(spark):
    held = []

    def batches():
        for _ in range(3):
            held.append(pa.total_allocated_bytes() - before)
            yield pa.RecordBatch.from_pydict({"id": pa.array(range(4000)), "text": pa.array(["some words " * 200] * 4000), "th": pa.array(range(4000))})

    run = substrings.units(Handed(), 20)
    before = pa.total_allocated_bytes()
    for _ in run(batches()):
        pass
    assert len(held) == 3 and max(held) < 4 << 20
