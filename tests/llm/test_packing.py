import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import ByteIds, Places, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    rng, ids = random.Random(2), ByteIds(PATH)
    bits = [" ", "\n", "\t", "a", "The", "é", "<|endoftext|>", "1", "½", "日", ".", "%%", "'s", "'", "\0", "\x1c", "\xa0", "́"]
    for _ in range(1000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(ids.text(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = dict(Counter(min(100, max(1, int(rng.lognormvariate(3, 1.1)))) for _ in range(5000)))
    if seed == 3:
        histogram |= {57: 40_000}
    packed = plan(histogram, 100, groups=16)
    got: Counter = Counter()
    for times, items in packed:
        assert sum(s * n for s, n in items) <= 100
        for s, n in items:
            got[s] += times * n
    assert got == histogram
    sequences = sum(t for t, _ in packed)
    least = -(-sum(s * n for s, n in histogram.items()) // 100)
    if seed < 3:
        assert sequences <= least * 1.02 + 1
    places = Places(packed, 100)
    used = {}
    for s, n in histogram.items():
        sequence, offset = places.of(np.full(n, s), np.arange(n))
        for q, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            used.setdefault(q, []).append((o, o + s))
    assert len(used) == places.sequences == sequences
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= 100


def test_plan_of_nothing_and_of_full_pieces():
    assert plan({}, 100) == []
    assert plan({100: 7}, 100) == [(7, ((100, 1),))]


def check(got, rows, library, capacity):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    texts = dict((i, t) for i, t, *_ in rows)
    for i, pieces in by_doc.items():
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        copies = sum(r[0] == i for r in rows)
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            want = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(want) == p.ids_crc32
            assert p.length == capacity or p.piece == 0
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    return len(by_sequence)


def test_documents(spark, library):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Lorem", "xq", "é", "12"]) for _ in range(rng.randint(0, 90))), "c") for i in range(200)]
    rows += [(900, None, "n"), (901, "", "n"), (902, "word " * 3000, "long"), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string").repartition(5)
    got = pack(docs, PATH, 64, groups=16).collect()
    sequences = check(got, rows, library, 64)
    assert sequences <= -(-sum(r.length for r in got) // 64) * 1.02 + 1
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert pack(docs.limit(0), PATH).count() == 0
