import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docvet.llm import kernels
from docvet.llm import toxicity as T


def corpus(n=900, seed=3):
    """Toxic words make a text toxic; muslim stands in toxic texts more often than by chance, and in neutral ones too."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["Scumbag,", "vilepest", "vilefool."])
        if rng.random() < (0.6 if toxic else 0.05):
            w[rng.randrange(len(w))] = "muslim"
        if rng.random() < 0.05:
            w[rng.randrange(len(w))] = "christian"
        rows.append((i, " ".join(w), int("cumbag" in " ".join(w) or "vile" in " ".join(w))))
    return rows


def tables(spark, rows, extra=()):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + list(extra), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_held_out_accuracy_and_columns(spark):
    rows = corpus()
    extra = [(9000, None), (9001, ""), (9002, "x" * 2_500_000 + " vilepest"), (None, "fine"), (0, rows[0][1])]
    docs, labels = tables(spark, rows, extra)
    docs = docs.withColumns({"toxic": F.lit(5), "_score": F.lit(7), "score": F.lit(8)})
    labels = labels.union(labels.limit(3)).union(spark.createDataFrame([(9001, None), (None, 1), (77777, 1)], "doc_id long, toxic int"))
    got = T.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    want = {i: y for i, _, y in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    out = [(want[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in want]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)
    by = {r.doc_id: r.score for r in got}
    assert by[9000] == by[9001] < 0.5 < 0.7 <= by[9002]
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_held_out_labels_are_never_seen(spark):
    docs, labels = tables(spark, corpus(300))
    other = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, T.classify(docs, labels).collect())) == sorted(map(tuple, T.classify(docs, other).collect()))


def test_swapping_identity_terms_changes_scores_less(spark):
    docs, labels = tables(spark, corpus(1500, 8))
    neutral = pa.array(["the muslim family lives here", "the christian family lives here", "a day with my neighbours"])
    gap = {}
    for penalty in (0.0, 5.0):
        s = T.train(docs, labels, penalty).scores(neutral)
        gap[penalty] = abs(s[0] - s[1])
    assert gap[5.0] < 0.3 * gap[0.0] and gap[5.0] < 0.05


def test_swapped():
    assert T.swapped("The Women and black-haired men; womenfolk") == "The men and white-haired women; womenfolk"
    assert T.swapped("nobody") is None and T.swapped(None) is None


def test_features_by_hand(monkeypatch):
    texts = ["Émile-émile ab Über", "", None, "abcd efgh abcd " * 40, "xyzzy"]
    both = lambda: [np.concatenate(x) for x in zip(*T.features(pa.array(texts)), strict=True)]
    whole = both()
    monkeypatch.setattr(kernels, "CHUNK", 64)
    cut = both()
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    assert set(whole[0].tolist()) == {0, 3, 4}
    assert len(whole[1][whole[0] == 4]) == 4  # xyzzy, xyz, xyzz, yzzy


def test_one_kind_of_label_and_no_rows(spark):
    docs, labels = tables(spark, corpus(50))
    for some in (labels.filter("toxic = 0"), labels.filter("false")):
        assert len({r.score for r in T.classify(docs, some).collect()}) == 1
    assert T.classify(docs.filter("false"), labels).count() == 0


def test_features_against_those_of_single_words():
    import re

    words = re.compile("[0-9a-z\u0080-\U0010ffff]+")
    texts = ["The cat, the CAT's hat; Ärger Ünter naïve x", "", None, "supercalifragilistic 12345678 a-b_c", "été " * 50 + "the end", "日本語 text"]
    got = {}
    for t, h in T.features(pa.array(texts, pa.string())):
        for a, b in zip(t.tolist(), h.tolist(), strict=True):
            got.setdefault(a, []).append(b)
    for i, text in enumerate(texts):
        want = set()
        for word in words.findall((text or "").lower()):
            raw = word.encode()
            parts = [word.encode()] + [raw[:n] for n in T.HEADS if len(raw) > n] + [raw[-n:] for n in T.TAILS if len(raw) > n]
            own = {x for _, h in T.features(pa.array([word])) for x in h.tolist()}
            assert len(own) == len(parts)
            want |= own
        assert sorted(got.get(i, [])) == sorted(want)


def test_fit_is_where_the_loss_is_least():
    rng = np.random.default_rng(3)
    n, width = 300, 12
    x = rng.random((n, width)) < 0.3
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 3 + x[:, 1] * 2 - 2)))).astype(float)
    swap = [None if k % 3 else sorted({*np.flatnonzero(x[k]).tolist()} ^ {1, 2}) for k in range(n)]
    own = [np.flatnonzero(r).tolist() for r in x]
    w, b = T.fit(y, own, swap, width)

    def loss(w, b):
        share = y.mean()
        total = 0.0
        for k in range(n):
            z = b + sum(w[f] for f in own[k])
            each = T.BALANCE / share if y[k] else (1 - T.BALANCE) / (1 - share)
            total += each / n * (np.log1p(np.exp(-z)) if y[k] else np.log1p(np.exp(z)))
        changed = [sum(w[f] for f in own[k]) - sum(w[f] for f in swap[k]) for k in range(n) if swap[k] is not None]
        return total + T.SQUARES / 2 * (w @ w) + T.COUNTERFACTUAL * np.mean(np.square(changed))

    for f in range(width + 1):
        step = np.eye(width + 1)[f] * 1e-4
        slope = (loss(w + step[:width], b + step[width]) - loss(w - step[:width], b - step[width])) / 2e-4
        assert abs(slope) < 2e-3, (f, slope)


def test_scores_are_sums_over_distinct_features():
    texts = ["a bad word and a bad day", "", None, "good day"]
    hashes = np.unique(np.concatenate([h for _, h in T.features(pa.array(texts, pa.string()))]))
    weights = np.linspace(-1, 1, len(hashes))
    got = T.Model(hashes, weights, 0.25).scores(pa.array(texts, pa.string()))
    for text, score in zip(texts, got, strict=True):
        mine = {x for word in set((text or "").split()) for _, h in T.features(pa.array([word])) for x in h.tolist()}
        z = 0.25 + sum(w for x, w in zip(hashes.tolist(), weights, strict=True) if x in mine)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12
