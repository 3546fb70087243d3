import numpy as np
import pytest

from tidemark.llm import vectors
from tidemark.llm.vectors import KdTree, chi_square, exact_top_k, near

IS_QUERY = "id % 20 = 0"


def plain(ids, x, k):
    out = {}
    for i in sorted({int(i) for i in ids if i % 20 == 0}):
        score = x @ x[ids.tolist().index(i)]
        score[ids == i] = -np.inf
        order = np.lexsort((ids, -score))[:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order if np.isfinite(score[j])]
    return out


def told(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, float(r.score)))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 24)) * 0.5).astype(np.float32)
    x[100:250] = x[100]  # a hot vector, so ties
    return np.arange(700), x


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(c) for c in v], "x") for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame([*rows, *extra], "vec_id bigint, embedding array<float>, score string").repartition(4)


ODD = [(1000, None, "n"), (1020, [1.0, None], "n"), (1040, [float("nan")] * 24, "n"), (1060, [float("inf")] * 24, "n"), (None, [1.0] * 24, "n")]


def test_exact_is_exact(spark, data):
    ids, x = data
    got = exact_top_k(frame(spark, ids, x, ODD), IS_QUERY)
    assert told(got) == plain(ids, np.floor(64 * x.astype(float)), 20)


def test_exact_in_query_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    ids, x = data
    assert told(exact_top_k(frame(spark, ids, x), IS_QUERY, k=3)) == plain(ids, np.floor(64 * x.astype(float)), 3)


def test_few_candidates_short_vectors_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert told(exact_top_k(df, IS_QUERY)) == {0: [(1, 3.0 * 64 * 64), (2, 0.0)]}
    assert told(near(df, IS_QUERY)) == {0: [(1, 3.0)]}
    assert exact_top_k(df.limit(0), IS_QUERY).count() == 0 and near(df.limit(0), IS_QUERY).count() == 0


def test_near_recall(spark, data):
    ids, x = data
    got, want = told(near(frame(spark, ids, x, ODD), IS_QUERY)), plain(ids, x.astype(float), 20)
    assert got.keys() == want.keys()
    # Ties of the hot vector are alike whichever is found, so scores are compared.
    hits = sum(sum(a[1] >= b[-1][1] - 1e-9 for a in got[q]) for q, b in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        for v, s in found:
            assert s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)))


def test_tree_boxes_hold_their_points():
    x = np.random.default_rng(1).normal(size=(500, 5))
    tree = KdTree(x, 16)
    assert sorted(np.concatenate(tree.leaves)) == list(range(500))
    q = np.random.default_rng(2).normal(size=(7, 5))
    boxes = tree.distances(q)
    for k, leaf in enumerate(tree.leaves):
        assert (boxes[:, k] <= ((q[:, None] - x[leaf]) ** 2).sum(2).min(1) + 1e-9).all()


def test_chi_square():
    assert chi_square(8, 0.95) == pytest.approx(15.507, rel=0.01)


def test_threshold_leaves_candidates_unresolved(spark, data):
    ids, x = data
    got, pairs, resolved = vectors._exact_top_k(frame(spark, ids, x, ODD), IS_QUERY)
    assert told(got) == plain(ids, np.floor(64 * x.astype(float)), 20)
    assert pairs.value == 35 * 700 and 0 < resolved.value < 0.6 * pairs.value


@pytest.mark.parametrize("size", [1e5, 1e6, 5e6])
def test_scores_beyond_doubles_are_exact(spark, size):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(60, 16)) * size + 0.37, 2)
    x[40:] = x[20:40] + rng.integers(-1, 2, (20, 16)) / 64  # scores that differ by little
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    whole = [[int(c) for c in np.floor(64 * v)] for v in x]
    want = {q: sorted(((sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in enumerate(whole) if i != q), key=lambda t: (-t[0], t[1]))[:20] for q in (0, 20, 40)}
    got: dict = {}
    for r in exact_top_k(df, IS_QUERY).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == want


def test_scores_that_no_long_holds_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e8, 1e8]), (1, [1e8, 2e8])], "vec_id bigint, embedding array<double>")
    with pytest.raises(OverflowError, match="long"):
        exact_top_k(df, IS_QUERY)


def test_a_query_id_with_several_vectors_counts_by_the_greatest(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 1.0]), (1, [3.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert told(exact_top_k(df, IS_QUERY)) == {0: [(1, 3.0 * 2 * 4096), (1, 2.0 * 4096)]}
    assert told(near(df, IS_QUERY)) == {0: [(1, 6.0), (1, 2.0)]}


def test_stopping_test_spares_candidates(spark):
    x = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, v = x.vec_id.to_numpy(), np.array(x.embedding.tolist(), float)
    got = near(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), IS_QUERY).toPandas()
    want = plain(ids, v, 20)
    hits = sum(len({i for i, _ in best} & set(got[got.query_id == q].vec_id)) for q, best in want.items())
    share = got.groupby("query_id").verified.first().mean() / len(ids)
    assert hits / sum(map(len, want.values())) >= 0.9 and share < 0.75
