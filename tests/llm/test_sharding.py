import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docvet.llm import sharding


def best(sizes, shards):
    """By dynamic programming: the least possible largest run."""
    n, inf = len(sizes), 1 << 60
    ends = [0, *np.cumsum(sizes).tolist()]
    cost = [0] + [inf] * n
    for _ in range(shards):
        cost = [min([cost[i], *(max(cost[j], ends[i] - ends[j]) for j in range(i))]) for i in range(n + 1)]
    return cost[n]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=25), st.integers(1, 6))
def test_least_capacity_and_even_cuts(sizes, shards):
    sizes = np.array(sizes)
    capacity = sharding.smallest_capacity(sizes, shards)
    assert capacity == best(sizes.tolist(), shards)
    cuts = [0, *sharding.even_cuts(sizes, shards, capacity), len(sizes)]
    assert cuts == sorted(cuts) and max(sizes[a:b].sum() for a, b in zip(cuts, cuts[1:], strict=False)) == capacity


def test_plan_sees_only_what_it_needs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    rng = np.random.default_rng(5)
    for _ in range(3):
        keys = np.unique(rng.integers(-(1 << 63), 1 << 63, 400))
        sizes = rng.integers(1, 1000, len(keys))
        sizes[7] = 9000
        groups = spark.createDataFrame(list(zip(keys.tolist(), sizes.tolist(), strict=True)), "key long, size long")
        firsts, capacity = sharding.plan(groups, 5)
        assert capacity == sharding.smallest_capacity(sizes, 5)
        shard = np.searchsorted(firsts, keys, side="right")
        assert max(np.bincount(shard, weights=sizes, minlength=5)) == capacity


def test_shards(spark):
    texts = [f"text {i % 90} é" * (i % 13) for i in range(400)] + [None, "", "z" * 100_000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1), (None, "n", None, None)]
    out = sharding.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string, key int"), 4).collect()
    assert len(out) == len(rows)
    by = dict(enumerate(texts)) | {None: "n"}
    where = {}
    for r in out:
        t = (by[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        assert where.setdefault(t, r.shard) == r.shard
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    totals = [sum(r.size for r in out if r.shard == s) for s in range(4)]
    assert max(totals) == max(100_001, max(totals))


def test_hot_group_and_few_groups(spark):
    rows = [(i, "same") for i in range(50)] + [(100, "other")]
    out = sharding.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.shard for r in out}) == 2 and all(0 <= r.shard < 16 for r in out)
    assert sharding.minimax_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
