import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from docvet.llm import mixing, toxicity
from tests.llm.test_near_dedup import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars"))
    out = [docs]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_rows(stages, spark):
    docs, clean, single, far, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[:5])
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    assert sorted(map(str, rows(clean))) == sorted(str(r) for r in rows(docs) if not predicted[r[0]])
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for i, t in rows(clean):
        key = (t or "").translate(low)
        last[key] = max(last.get(key, -1), -1 if i is None else i)
    assert sorted((-1 if i is None else i) for i, _ in rows(single)) == sorted(last.values())
    some = {i: t for i, t in rows(single) if i is not None}
    want = brute(sorted(some.items()), 5)
    assert sorted(i for i, _ in rows(far) if i is not None) == [i for i in sorted(want) if want[i][2]]
    assert sorted(map(str, rows(mixed))) == sorted(map(str, rows(far)))
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in rows(far)}


def test_run(spark, stages):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in stages[-1].collect()} - {None}


def test_sequences_follow_the_weights(stages, spark, tmp_path):
    far, starts = stages[3], {}
    hot = max(r.source for r in far.select("source").distinct().collect() if r.source)
    for weight in (1000.0, 0.0001):
        path = str(tmp_path / str(weight))
        mixing.mixed(far, {hot: weight}, power=0.0, block_rows=1).write.parquet(path)
        first = P.packed(spark, spark.read.parquet(path), "").join(far.select("doc_id", "source"), "doc_id").orderBy("sequence_id", "offset").limit(40).collect()
        starts[weight] = sum(r.source == hot for r in first)
    assert starts[1000.0] > starts[0.0001]
