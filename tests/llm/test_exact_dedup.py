from pyspark.sql import functions as F

from docvet.llm import exact_dedup as X


def brute(rows):
    low = str.maketrans(X.UPPER, X.LOWER)
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(low), []).append(d)
    return groups


def test_edge_cases(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, "Äb"), (4, "äb"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (None, "ab"), (9, "solo"), (9, "solo"), (9, "solo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("clash"), "kept": F.lit(1), "at": F.lit(2), "stays": F.lit(3), "_AT": F.lit(4), "_at_": F.lit(5)})
    out = X.exact_dedup(docs).collect()
    assert len(out) == len(rows)
    groups = brute(rows)
    for members in groups.values():
        got = [r for r in out if r.doc_id in members or (r.doc_id is None and None in members)]
        assert {r.keep_id for r in got} == {max(m for m in members if m is not None)}
        assert {r.group_size for r in got} == {len(members)}
        assert sum(r.kept for r in got) == 1
    stays = X.drop_copies(docs)
    assert stays.columns == docs.columns and sorted(r.doc_id for r in stays.collect()) == [2, 3, 4, 6, 8, 9]


def test_equal_digests_of_different_texts(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = X.exact_dedup(docs, hashed=lambda t: F.substring(X.digest(t), 1, 0)).collect()
    want = {i: max(members) for members in brute(rows).values() for i in members}
    assert {r.doc_id: r.keep_id for r in out} == want
    assert all(r.kept == (r.doc_id == r.keep_id) and r.group_size in (8, 9) and len(r.text_sha256) == 64 for r in out)


def test_state_goes_on_over_batches(spark):
    docs = spark.createDataFrame([(i, f"t{i % 10}") for i in range(100)], "doc_id long, text string").repartition(5)
    out = X.exact_dedup(docs, files_per_batch=2).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == {(i, 90 + i % 10, 10) for i in range(100)}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert X.exact_dedup(docs).count() == 0 and X.drop_copies(docs).count() == 0
