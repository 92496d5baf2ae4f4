import numpy as np
import pytest
from pyspark.sql import functions as F

from docvet.llm import knn


def brute(rows, k, every):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = set()
    for q, v in {i: v for i, v in ok if i % every == 0}.items():
        all_ = sorted((-int(v @ x), i) for i, x in ok if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(all_[:k])}
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_against_brute_force(spark, monkeypatch, clustered):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(knn, "QUERY_ROWS", 7)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 6)) * (8 if clustered else 0)
    rows = [(i, (centers[i % 12] + rng.normal(size=6) * 0.3).tolist()) for i in range(1200)]
    rows += [(2000 + i, [1.0] * 6) for i in range(300)]  # equal vectors and ties
    rows += [(3000, None), (3010, [1.0, None] + [0.0] * 4), (3020, [float("nan")] * 6), (3030, [float("inf")] * 6), (3040, [0.5, 2.0]), (3050, []), (None, [1.0] * 6)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cell": F.lit(1), "vector": F.lit("x")})
    got = knn.top_k(docs, 5, 10).collect()
    assert {tuple(r) for r in got} == brute(rows, 5, 10) and len(got) == len({tuple(r) for r in got})


def test_bounds_leave_cells_out():
    pivots = np.array([[100.0, 0], [-100.0, 0], [0, 50.0]])
    may = knn.needed(pivots, np.array([50, 50, 5]), np.array([1.0, 1.0, 1.0]), np.array([1.0, 1.0, 1.0]), 10)
    assert may.tolist() == [[True, False, False], [False, True, False], [True, True, True]]


def test_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert knn.top_k(one).count() == 0 and knn.top_k(one.filter("false")).count() == 0
    two = spark.createDataFrame([(0, [1.0, -0.0001]), (7, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.top_k(two).collect()] == [(0, 1, 7, 1024 * 512 - 1024)]


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {tuple(r) for r in knn.top_k(rows).collect()}
    assert got == brute([(r.vec_id, list(map(float, r.embedding))) for r in rows.collect()], 10, 100)


def test_repeated_query_ids_prune_no_neighbours(spark):
    rows = [(0, [100.0, 0.0])] * 40 + [(i, [-100.0, 0.0]) for i in range(101, 400)] + [(i, [0.0, 50.0]) for i in range(401, 700)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1000).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 11)) and {(r.query_id, r.vec_id, r.score) for r in got} == {(0, i, 0) for i in range(401, 411)}


def test_repeated_rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 4)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(20, vectors[20]), (20, vectors[20]), (7, vectors[7])]
    got = sorted(map(tuple, knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 20).collect()))
    want = []
    for q in (0, 20, 40):
        scores = sorted((-int(np.floor(1024 * np.array(vectors[q])) @ np.floor(1024 * np.array(v))), i) for i, v in rows if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert got == want


def test_plan_of_a_million_vectors_stays_small():
    assert knn._joined([(0, 3), (5, 9), (2, 4), (12, 12)]) == [(0, 9), (12, 12)]
    spans = [(g * 40, g * 40 + 39) for g in range(knn.MOST_PIVOTS)]
    assert knn._joined(spans) == [(0, 40 * knn.MOST_PIVOTS - 1)]
