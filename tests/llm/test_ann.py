import numpy as np
import pytest
from pyspark.sql import functions as F

from warpsift.llm import ann


def table(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def best(vectors, ids, query, k):
    x = np.asarray(vectors, np.float32).astype(np.float64)
    scores = x @ x[query]
    order = [i for i in np.lexsort((ids, -scores)) if i != query][:k]
    return [(ids[i], scores[i]) for i in order]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_against_all_pairs(spark, lengths):
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 24))
    x = centres[r.integers(0, 8, 3000)] + 0.7 * r.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths:
        x *= r.uniform(0.3, 3, (3000, 1))
    out = found(ann.Index(table(spark, x)).search(F.col("id") % 20 == 0))
    ids, hit = np.arange(3000), 0
    for q in range(0, 3000, 20):
        want = best(x, ids, q, ann.K)
        assert len(out[q]) == ann.K
        hit += len({i for i, _ in want} & {i for i, _ in out[q]})
        scores = dict(zip(ids, np.float32(x).astype(np.float64) @ np.float64(np.float32(x[q]))))
        assert all(abs(scores[i] - s) < 1e-12 for i, s in out[q])
        assert out[q] == sorted(out[q], key=lambda p: (-p[1], p[0]))
    assert hit / (150 * ann.K) >= 0.93


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    out = found(ann.op6_adaptive_scan(spark, sf))
    hit = [len({i for i, _ in best(x, ids, q, 20)} & {i for i, _ in out[ids[q]]})
           for q in range(len(ids)) if ids[q] % 20 == 0]
    assert np.mean(hit) / 20 >= 0.93 and len(out) == len(hit)


def test_scan_abandons_and_keeps():
    r = np.random.default_rng(4)
    x, q = r.normal(size=(500, 64)).astype(np.float32), r.normal(size=(20, 64)).astype(np.float32)
    turn = ann.rotation(64).astype(np.float32)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-5)
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    limits = np.sort(d, axis=1)[:, 10]
    i, j, far = ann.scan(x @ turn, q @ turn, limits)
    assert np.allclose(far, d[i, j], rtol=1e-3)
    near = {(a, b) for a, b in zip(*np.nonzero(d <= limits[:, None]))}
    kept = set(zip(i.tolist(), j.tolist()))
    assert len(near - kept) <= 0.03 * len(near) and len(kept) < 1.2 * len(near)
    everything = ann.scan(x @ turn, q @ turn, np.full(20, np.inf, np.float32))
    assert len(everything[0]) == 20 * 500


def test_ties_go_to_the_smaller_id_also_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 16)
    monkeypatch.setattr(ann, "QUERIES", 2)
    x = [[1.0, 0.0, 0.0]] * 300 + [[0.0, 1.0, 0.1 * i] for i in range(30)]
    out = found(ann.Index(table(spark, x)).search(F.col("id").isin(0, 100, 299), k=7))
    assert [i for i, _ in out[0]] == [1, 2, 3, 4, 5, 6, 7]
    assert [i for i, _ in out[100]] == [0, 1, 2, 3, 4, 5, 6]
    assert [i for i, _ in out[299]] == [0, 1, 2, 3, 4, 5, 6]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1),
            (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1), (7, [1.0, 1.0], None),
            (8, [3.0, -1.0], 1), (9, [1.0, 1.0, 1.0], 1), (8, [3.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    out = found(ann.Index(df.withColumn("own", F.lit(1))).search(F.col("id") % 20 == 0))
    assert out == {0: [(7, 3.0), (8, 1.0), (8, 1.0)]}
    empty = ann.Index(df.where("vec_id in (1, 2, 3)")).search(F.col("id") % 20 == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0
    assert ann.Index(df.where("vec_id = 0")).search(F.col("id") == 0).count() == 0
