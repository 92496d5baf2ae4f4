import bisect
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docvet.llm import mixing


def fluid(blocks, weights, t):
    """What each source has of the first t slots if every slot is shared out exactly."""
    done, left = [Fraction(0)] * len(blocks), Fraction(t)
    while left > 0:
        active = [k for k, n in enumerate(blocks) if done[k] < n]
        total = sum(Fraction(weights[k]) for k in active)
        step = min(left, min((blocks[k] - done[k]) * total / Fraction(weights[k]) for k in active))
        for k in active:
            done[k] += step * Fraction(weights[k]) / total
        left -= step
    return done


def check_lag(blocks, weights, every=1):
    slots = mixing.pfair(blocks, mixing.whole(weights))
    assert sorted(t for s in slots for t in s) == list(range(sum(blocks))) and list(map(len, slots)) == blocks
    for t in range(0, sum(blocks) + 1, every):
        for s, exact in zip(slots, fluid(blocks, weights, t), strict=True):
            assert abs(bisect.bisect_left(s, t) - exact) < 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.floats(0.0001, 100)), min_size=1, max_size=8))
def test_lag_stays_under_one_block(sources):
    check_lag([b for b, _ in sources], [w for _, w in sources])


def test_weights_of_one_in_ten_thousand_and_hot_sources():
    check_lag([3, 30_000], [1e-4, 1 - 1e-4], 97)
    check_lag([3000] + [300] * 19, [1e6**0.7] + [1e5**0.7] * 19, 53)
    check_lag([3000, 3000, 5], [1e7**0.7, 1e7**0.7, 5e3**0.7], 7)


def test_many_sources():
    plan = {k: 0 for k in range(6000)}
    for k, _, phase, slot, release, deadline, start in mixing.plan_rows([1 + k % 70 for k in range(6000)], [1.0 + k % 7 for k in range(6000)], 32, 64):
        assert all(r <= s < d for r, s, d in zip(release, slot, deadline, strict=True)) and phase == sorted(phase)
        plan[k] += len(start)
    assert plan == {k: -(-(1 + k % 70) // 32) for k in range(6000)}


def rows_of(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 5}") for i in range(700)] + [(1000, None, None), (1001, "x", ""), (5, "t5", "hot"), (None, "y", "hot")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"slot": F.lit(1), "position": F.lit(2), "_src": F.lit(3)})


def test_mix(spark):
    docs = rows_of(spark)
    out = mixing.mix(docs, {"hot": 3.0, "s0": 1.0, None: 0.5}, block_rows=4, period=32).orderBy("position").collect()
    assert [r.position for r in out] == list(range(704))
    assert sorted((str(r.doc_id), str(r.source)) for r in out) == sorted((str(r.doc_id), str(r.source)) for r in docs.collect())
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert len({(r.slot, r.source) for r in out}) == len({r.slot for r in out})
    assert [r.position for r in out if r.source == "hot"] == [r.position for r in sorted((r for r in out if r.source == "hot"), key=lambda r: (r.block, r.position))]


def test_mixed_keeps_rows_in_order(spark, tmp_path):
    docs = rows_of(spark)
    mixing.mixed(docs, block_rows=4, period=32).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0


def test_written_plan_places_the_same_rows(spark, monkeypatch):
    docs = rows_of(spark)
    given_ = {"hot": 0.7123, "s0": 0.001, "s1": 0.0, None: 0.5}
    want = sorted(map(str, mixing.mix(docs, given_, block_rows=4, period=8).collect()))
    assert sorted(map(str, mixing.mix(docs, given_, block_rows=4, period=1000).collect())) == want
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 20)
    assert sorted(map(str, mixing.mix(docs, given_, block_rows=4, period=8).collect())) == want
    out = mixing.mix(docs, given_, block_rows=4, period=8).orderBy("position").collect()
    assert [r.position for r in out] == list(range(704)) and all(r.release <= r.slot < r.deadline for r in out)
