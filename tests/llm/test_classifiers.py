import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return (np.sign(pos[:, None] - neg[None]) + 1).mean() / 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiounrtsl") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic, good = i % 6 == 0, i % 5 != 1
        for _ in range(rng.randint(2, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "vexolot", "stulmpf"]) + rng.choice(["", "a", "en"]))
        if not good:
            w = rng.choice([[x + "!!" for x in map(str.upper, w)], [x for x in w for _ in range(6)], [x + "%%%" for x in w]])
        rows.append((i, " ".join(w), "hidden", i))
        if i % 10:
            labels.append((i, int(good), int(toxic)))
    rows += [(2000, None, "s", 0), (2001, "", "s", 0), (None, "text", "s", 0), rows[3], (2002, "word " * 30000, "s", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score bigint").repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "parts", "held"), [(toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)])
def test_held_out_accuracy(labelled, module, label, parts, held):
    docs, labels = labelled
    got = module.scored(docs, labels).toPandas()
    assert len(got) == 905 and got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    import zlib

    assert all(bool(h) == (zlib.crc32(str(int(i)).encode()) % parts == held) for i, h in zip(got.doc_id, got.held_out, strict=True) if i == i)
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    assert len(both) > 100 and auc(both[label].to_numpy(), both.score.to_numpy()) > 0.97
    assert (both.predicted == both[label]).mean() > 0.95


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_are_not_looked_at(labelled, module, label):
    docs, labels = labelled
    parts, held = (4, 2) if module is toxicity else (5, 0)
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % parts == held, 1 - F.col(label)).otherwise(F.col(label)))
    one, two = (module.scored(docs.where("doc_id < 100"), x).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels_and_empty_tables(labelled, module):
    docs, labels = labelled
    assert {r.score for r in module.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert module.scored(docs.limit(0), labels).count() == 0


def test_clean_documents_stay(labelled):
    docs, labels = labelled
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(ids & toxic) < 0.1 * len(toxic) and {2000, 2001, None} <= ids and len(ids) > 700


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    raw = toxicity.Trees(trees=40).fit(x[:1500], y[:1500]).raw(x[1500:])
    assert auc(y[1500:], raw) > 0.98


def test_isotonic_pools_violators():
    iso = toxicity.Isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    got = iso(np.array([-9.0, 0, 1.5, 3, 9]))
    assert (np.diff(got) >= 0).all() and got[2] == pytest.approx(0.5, abs=0.01) and got[0] < 0.01 < 0.99 < got[-1]


def test_disguised_words_are_seen():
    scorer = toxicity.Scorer({"idiot": 8.0})
    names = scorer.names
    plain, hidden, far = (dict(zip(names, scorer(t), strict=True)) for t in ("you idiot here", "such an 1d10t, id!ot x", "idiot " + "a " * 20 + "you"))
    assert plain["near"] > 0 and plain["hits1"] == 1 and far["near"] == 0
    assert hidden["disguised_hits"] >= 1


def test_machine_equals_all_pairs():
    m = quality.FactorisationMachine(columns=6, rank=3)
    m.w, m.bias = np.arange(6) / 10, 0.2
    c, v = np.array([0, 2, 5]), np.array([1.0, 2.0, -1.0])
    pairs = sum(m.v[a] @ m.v[b] * x * y for k, (a, x) in enumerate(zip(c, v, strict=True)) for b, y in list(zip(c, v, strict=True))[k + 1 :])
    assert m.raw(c, v, np.array([0]))[0] == pytest.approx(0.2 + m.w[c] @ v + pairs)
