import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docvet.llm import kernels, packing

WHOLE = Tokenizer.from_file(packing.default_tokenizer())
ODD = ["", None, "Hello, World. it's we'll <|endoftext|> <|EndOfText|> don't!", "É é́ ﬁ Straße ǅ 12a3 a\x0bb c\x0cd e\x1cf g\x85h i\xa0j  k", "日本語 テキスト。", "x" * 5000, "a.b.c. d! e?! ...", "ı İ ſ K", "0\x000", "'s 'S x's.", "nul l​z", "Σας ΣΑΣ.", "end.\n", "tab\tnew\r\nline"]


def direct(texts):
    return [e.ids for e in WHOLE.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdefgh éß.,'1 \n<|>") for _ in range(rng.randrange(200))) for _ in range(300)]
    got = [x.tolist() for x in packing.WordTokens(None).texts(pa.array(texts))]
    for t, a, b in zip(texts, got, direct(texts), strict=True):
        assert a == b, t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_ids_of_any_texts(texts):
    assert [x.tolist() for x in packing.tokens_of(None).texts(pa.array(texts, pa.string()))] == direct(texts)


def test_long_texts_and_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 50)
    words = "the of Andrews's l'été worth, less. x" + " ".join(f"w{i}" for i in range(40000))
    texts = [words * 4, "y" * 1_200_000, words[:5000]]
    monkeypatch.setattr(kernels, "CHUNK", 100_000)
    got = [x.tolist() for x in packing.WordTokens(None).texts(pa.array(texts))]
    assert got == direct(texts)


def naive(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    fill, seen = {}, {n: [] for n in counts}
    for length, first, end, start, each, at in packing.best_fit_decreasing(counts, 64):
        for i in range(end - first):
            b, off = start + i // each, at + i % each * length
            fill.setdefault(b, []).append((off, length))
            seen[length].append(first + i)
    assert all(sorted(seen[n]) == list(range(c)) for n, c in counts.items())
    for items in fill.values():
        items.sort()
        assert [o for o, _ in items] == [int(x) for x in np.cumsum([0, *(n for _, n in items[:-1])])]
    assert sorted(64 - sum(n for _, n in items) for items in fill.values()) == naive(lengths, 64)


def test_pack(spark):
    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choice(["the", "worth", "été", "x1"]) for _ in range(rng.randrange(0, 150))) for _ in range(200))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, texts[7], "again"), (None, "no id", None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), capacity=100).collect()
    ids = {(r[0], r[1]): [*d, 0] for r, d in zip(rows, direct([r[1] for r in rows]), strict=True)}
    assert sum(r.length for r in out) == sum(len(ids[r[0], r[1]]) for r in rows)
    by = dict(enumerate(texts)) | {None: "no id"}
    for r in out:
        want = np.array(ids[r.doc_id, by[r.doc_id]][r.start : r.start + r.length], "<u4")
        assert r.start == r.piece * 100 and r.length == len(want) <= 100 and r.ids_crc32 == zlib.crc32(want.tobytes())
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 100
    assert sorted(100 - sum(n for _, n in v) for v in sequences.values()) == naive([r.length for r in out], 100)


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_another_tokenizer():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    got = packing.WordTokens(path)
    assert not got.by_words and packing.WordTokens(None).by_words
    assert [x.tolist() for x in got.texts(pa.array(ODD))] == [e.ids for e in whole.encode_batch([t or "" for t in ODD], add_special_tokens=False)]


def test_sequences_follow_the_files_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green"]) for _ in range(rng.choice([1, 5, 20, 60, 60, 60])))) for i in rng.sample(range(1000), 300)]
    orders = []
    for n, some in enumerate((rows, rows[::-1])):
        path = str(tmp_path / str(n))
        spark.createDataFrame(some, "doc_id long, text string").repartition(1).write.parquet(path)
        docs = spark.read.parquet(path)
        place = {r.doc_id: k for k, r in enumerate(docs.collect())}
        got = packing.pack(docs.withColumn("place", F.lit("x")), capacity=64, ordered=True).collect()
        assert sorted(map(str, ((r.doc_id, r.piece, r.length) for r in got))) == sorted(map(str, ((r.doc_id, r.piece, r.length) for r in packing.pack(docs, capacity=64).collect())))
        held = {}
        for r in got:
            held.setdefault(r.sequence_id, []).append(r)
        for members in held.values():
            at = 0
            for r in sorted(members, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 64
        firsts = [min(place[r.doc_id] for r in held[s]) for s in sorted(held)]
        assert firsts == sorted(firsts)
        orders.append([r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))])
    assert orders[0] != orders[1]
