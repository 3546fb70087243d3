import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def plain(rows):
    sets = [(r[0], sets_of(r[1])) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * (n := len(s & t)) >= 75 * (len(s) + len(t) - n):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    hot = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 100))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, max(1, len(w) // 20))):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.4:
            w = w[: len(w) // 2] + hot + w[len(w) // 2 :]
        rows.append((i, " \n".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "a b c"), (n + 4, "A b  c"), rows[3], (None, rows[3][1]), (None, None)]
    rng.shuffle(rows)
    return rows


def test_components_are_those_of_all_pairs(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, n string").repartition(3)
    got = Counter(tuple(r) for r in jaccard.groups(docs).collect())
    assert got == plain(rows)
    kept = jaccard.keep_one(docs)
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for _, _, c in got if c is not None}) and kept.columns == docs.columns


def short_variants(seed, families=700):
    """Texts of eight shingles, parts of six (0.75 alike), and shorter parts that make some shingles more frequent."""
    rng, rows = random.Random(seed), []
    for f in range(families):
        w = [f"f{f}x{rng.randint(0, 99999)}" for _ in range(12)]
        at = rng.randint(0, 2)
        rows += [w, w[at : at + 10]]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, 6)
            rows.append(w[at : at + rng.randint(5, 7)])
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def hidden_links(seed, tries=60000):
    """A text of eight shingles beyond the band and its part of six, 0.75 alike, that meet under ``a`` alone: the
    longer offers its own two and ``a``, the part ``a`` and ``b``, and ``b`` is rarer. Others lead the block of ``a``."""
    rng, rows = random.Random(seed), []
    long = [[f"h{rng.randint(0, 10**9)}" for _ in range(12)] for _ in range(tries)]
    hashed = lambda ws: [s.tolist() for s in jaccard.shingle_sets(pa.array([" ".join(w) for w in ws]), 5)]
    for w, s in zip(long, hashed(long), strict=True):
        at = next((k for k in range(3) if s[0] >= jaccard.BAND and set(s[2:]) == set(hashed([w[k : k + 10]])[0])), None) if len(s) == 8 and s[0] >= jaccard.BAND else None
        if at is None:
            continue
        a, b = (next(w[k : k + 5] for k in range(8) if hashed([w[k : k + 5]])[0] == [h]) for h in s[2:4])
        ends = [[*a, f"e{k}"] for k in range(200)]
        tail = next((e for e, t in zip(ends, hashed(ends), strict=True) if t[0] == s[2]), None)
        if tail:
            rows.append((a, w, w[at : at + 10], b, tail))
    return rows


def test_short_sets_at_the_threshold_are_linked(spark):
    planted = hidden_links(1)
    assert len(planted) > 10
    rows = short_variants(5)
    rows += [(10000 * (k + 1) + i, " ".join(w)) for k in range(5) for i, w in enumerate(p[k] for p in planted)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(tuple(r) for r in jaccard.groups(docs).collect()) == plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.groups(docs).count() == 0 and jaccard.keep_one(docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_all_that_the_bounds_allow(seed):
    rng = np.random.default_rng(seed)
    base = rng.poisson(2, (40, jaccard.GROUPS))
    points = np.abs(base[rng.integers(0, 40, 500)] + rng.integers(-1, 2, (500, jaccard.GROUPS)) * (rng.random((500, jaccard.GROUPS)) < 0.2))
    sizes = points.sum(1)
    tree = jaccard.CountTree(points, sizes, leaf=8)
    for q in range(0, 500, 7):
        want = [i for i in range(500) if 4 * min(sizes[i], sizes[q]) >= 3 * max(sizes[i], sizes[q]) and np.minimum(points[i], points[q]).sum() >= jaccard.need(sizes[q], sizes[i])]
        assert sorted(tree.search(q).tolist()) == want


def test_prefixes_of_alike_sets_meet():
    rng = random.Random(1)
    for _ in range(300):
        a = set(rng.sample(range(200), rng.randint(1, 60)))
        b = set(rng.sample(sorted(a), max(1, int(len(a) * 0.9)))) | {rng.randint(200, 300) for _ in range(rng.randint(0, 6))}
        if 100 * len(a & b) >= 75 * len(a | b):
            assert set(sorted(a)[: jaccard.probe(len(a))]) & set(sorted(b)[: jaccard.probe(len(b))])


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 40, "CELL_SHINGLES": 900, "SMALL_IDS": 10}])
def test_near_copies_and_a_common_line_give_few_rows(spark, monkeypatch, limits):
    """Several hundred near copies of a text, not all alike, beside texts that share a line with them."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rng, line = random.Random(7), [f"line{k}" for k in range(9)]
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 5])):
            w[rng.randrange(40)] = f"r{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w + line)))
    rows += [(500 + i, " ".join(line + [f"o{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 12))])) for i in range(400)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    made, seen = {}, {f: getattr(jaccard, f) for f in ("near_sets", "tree_links", "in_cells")}

    def counted(name):
        def run(rows, *rest):
            out = seen[name](rows, *rest)
            made.setdefault(name, []).append((rows.count(), out.count()))
            return out

        return run

    for name in seen:
        monkeypatch.setattr(jaccard, name, counted(name))
    assert Counter(tuple(r) for r in jaccard.groups(docs).collect()) == plain(rows)
    assert all(out <= given for name in ("near_sets", "tree_links") for given, out in made[name])
    assert limits or all(out <= given for given, out in made["in_cells"])


def test_words_that_a_polynomial_takes_for_one(spark):
    odd = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = odd.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"w x y z {odd}"), (2, f"w x y z {other}"), (3, f"w x y z {other}")]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 2)]


def test_rows_that_repeat_an_id_and_clashing_columns(spark):
    rows = [(1, "a b c d e", "x", 1), (1, "a b c d e f g", "x", 2), (2, "a b c d e", "x", 3), (3, "A b c d e f g", "x", 4), (1, None, "x", 5), (None, "a b c d e", "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id__ string, id int")
    got = Counter(map(tuple, jaccard.groups(docs).collect()))
    assert got == Counter([(1, 1, 1), (1, 3, 1), (2, 1, 2), (3, 3, 1), (1, 0, 1), (None, 1, None)])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.id for r in kept.collect()) == [2, 3, 6]
