import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docvet.llm import suffix_dedup as S


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            i_ = S.NOBODY if i is None else i
            first[s] = min(first.get(s, S.NOBODY), i_)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (S.NOBODY if i is None else i):
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in rng.sample(range(10_000), n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a : a + 60], p[: 49], p[a:], " ".join(word() for _ in range(20)), "ab" * rng.randrange(60)]))
        rows.append((i, rng.choice(["", " ", "\x00", "."]).join(parts)))
    return rows


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 18), (500, 300)])
def test_against_brute_force(spark, monkeypatch, sizes):
    rows = corpus(1) + [(20_000, None), (20_001, ""), (20_002, "x" * 49), (20_003, "x" * 50), (20_004, "x" * 51)]
    rows += [rows[3], (None, rows[5][1] + "tail"), (None, rows[5][1])]
    monkeypatch.setattr(S, "CHUNK_BYTES", sizes[0])
    monkeypatch.setattr(S, "SHARD_BYTES", sizes[1])
    monkeypatch.setattr(S, "MERGED_STRINGS", sizes[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit(1), "part": F.lit(2), "data": F.lit("x")})
    got = S.digest_columns(S.remove_repeats(docs.repartition(5))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_anchors_do_not_depend_on_the_place(monkeypatch):
    rng = np.random.default_rng(4)
    text = rng.integers(97, 100, 6000).astype(np.uint8)
    whole = S.anchors(text, np.array([len(text)]))
    assert whole[1].sum() == len(text) - 49 and (np.diff(whole[0]) == whole[1][:-1]).all()
    monkeypatch.setattr(S.kernels, "CHUNK", 700)
    lo, count, off, h = S.anchors(text, np.array([len(text)]))
    windows = lambda a: {s: (x + f, g) for l, c, f, g in zip(a[0], a[1], a[2], a[3][0], strict=True) for s, x in ((l + k, l) for k in range(c))}  # noqa: E731, E741
    assert windows((lo, count, off, h)) == windows(whole)


def test_transforms_and_merge():
    rng = np.random.default_rng(6)
    for _ in range(20):
        texts = [np.append(rng.integers(97, 99, rng.integers(1, 200)), S.END).astype(np.uint8) for _ in range(rng.integers(1, 5))]
        for t in texts:
            o = S.suffix_order(t, 1 << 10)
            assert [bytes(t[i:]) for i in o] == sorted(bytes(t[i:]) for i in range(len(t)))
        flat = b"".join(map(bytes, texts))
        starts, classes = np.cumsum([0, *map(len, texts)]), S.repeat_classes(texts, 8)
        by = {}
        for k, t in enumerate(texts):
            for i in range(len(t) - 8):
                by.setdefault(bytes(t[i : i + 8]), set()).add(int(classes[starts[k] + i]))
        assert all(len(c) == 1 for c in by.values()) and len(set.union(*by.values(), set())) == len(by) and len(flat) == len(classes)


def test_more_shards_than_a_byte_can_number():
    rng = np.random.default_rng(8)
    texts = [np.append(rng.integers(97, 99, 12), S.END).astype(np.uint8) for _ in range(300)]
    classes = S.repeat_classes(texts, 6)
    by = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 6):
            by.setdefault(bytes(t[i : i + 6]), set()).add(int(classes[13 * k + i]))
    assert all(len(c) == 1 for c in by.values()) and len(set.union(*by.values())) == len(by)


def test_long_text(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(5, text), (6, "y" + text[700_000:701_000] + "z"), (7, text[:100] + "q" + text[-3000:])]
    got = S.digest_columns(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in got) == [(5, 0, 0), (6, 1000, 1), (7, 3100, 2)]


def test_no_documents(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
