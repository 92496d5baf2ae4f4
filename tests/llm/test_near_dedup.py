import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docvet.llm import kernels
from docvet.llm import near_dedup as N


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, size=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 6, 30, 60, 120]))] for _ in range(40)]
    rows = []
    for i in range(size):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, len(w) // 12, len(w) // 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w).replace("w1", rng.choice(["w1", "W1"]))))
    return rows


def test_words_and_hashes(monkeypatch):
    texts = ["", None, "A b\tC\x0bd\x0c é\xa0x Éz", "one", "  x  ", "", "abc" * 40, "y z " * 30]
    monkeypatch.setattr(kernels, "CHUNK", 64)
    got = {}
    for i, j, h, bounds in kernels.text_words(pa.array(texts)):
        for k in range(j - i):
            got[i + k] = h[bounds[k] : bounds[k + 1]].tolist()
    assert sorted(got) == list(range(len(texts)))
    by = {}
    for i, t in enumerate(texts):
        assert len(words(t)) == len(got[i])
        for w, x in zip(words(t), got[i], strict=True):
            assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60) if i % 20] + [(500, i) for i in range(100, 160)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.id: r.root for r in N.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in pairs if a != b for i in (a, b)}


def test_against_brute_force(spark):
    for seed, n in ((1, 2), (2, 5)):
        rows = corpus(seed) + [(900, None), (901, ""), (902, "   \n"), (903, "x " * 60_000), (904, "X  " * 60_000)]
        docs = spark.createDataFrame(rows + rows[:3] + [(None, "w1 w2 w3")], "doc_id long, text string").withColumns({"n": F.lit(1), "id": F.lit(2), "rep": F.lit(3), "key": F.lit("k")})
        got = N.near_duplicates(docs.repartition(6), n).collect()
        assert len(got) == len(rows) + 4
        want = brute(rows, n)
        assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
        stays = N.drop_near(docs, n)
        assert stays.columns == docs.columns and {r.doc_id for r in stays.collect()} == {i for i, w in want.items() if w[2]} | {None}


def test_hot_group_with_chains(spark):
    rng = random.Random(5)
    w = [f"h{i}" for i in range(50)]
    rows = []
    for i in range(300):  # each differs a little more from the first: a chain whose ends aren't similar
        w[rng.randrange(50)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, 2)


def test_other_similarities(spark):
    for percent, n in ((50, 1), (60, 2), (100, 2)):
        rows = [*corpus(7, 150), (900, "a b c"), (901, "a b c d")]
        got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, n, percent)
    for percent in range(N.LEAST_PERCENT, 100):
        t = N.Tables.of(percent)
        assert 1 - (1 - (1 - (percent / 100) ** t.values) ** t.halves) ** 2 <= N.MISSED and 2 * t.halves * t.values <= 512
    with pytest.raises(ValueError):
        N.Tables.of(20)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "SLICE", 64)
    rng = random.Random(11)
    base = [f"g{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(2, 8)):
            w[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = brute(rows, 2)
    for rounds in (4, 0):
        monkeypatch.setattr(N, "NEAREST_ROUNDS", rounds)
        got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_parts_of_a_group_meet_without_all_their_pairs(spark, monkeypatch):
    common = [f"c{i}" for i in range(180)]
    rows = [(0, " ".join(common + [f"d{i}" for i in range(30)]))]  # shares tables with all, links with none
    rows += [(i, " ".join(common + [f"k{i % 8}_{j}" for j in range(16)] + [f"u{i}_{j}" for j in range(4)])) for i in range(1, 241)]
    pairs = []

    def linked(tmp, docs, found, *rest):
        pairs.append(found.count())
        return true_linked(tmp, docs, found, *rest)

    true_linked = N.linked
    monkeypatch.setattr(N, "linked", linked)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, 1)
    assert sum(pairs) <= 5 * len(rows)  # 8 parts of 30 have 25,200 pairs
    monkeypatch.setattr(N, "NEAREST_ROUNDS", 0)
    monkeypatch.setattr(N, "ASKS", 130)
    monkeypatch.setattr(N, "PAIRS", 200)
    assert sorted(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()) == sorted(got)


def test_asking_goes_on_to_the_last_candidate():
    tables, rng = N.Tables.of(80), np.random.default_rng(3)
    size, width = 500, 2 * N.Tables.of(80).halves
    sketches = [np.packbits(np.arange(N.SKETCH_BITS) < d).tobytes() for d in rng.integers(0, 20, size)]
    halves = np.arange(width * size).reshape(size, width)
    halves[:300, 1], halves[100:400, tables.halves + 2] = -1, -1  # 100 to 299 share a table
    roots = np.where(np.arange(size) % 10 == 0, 150, np.arange(size))
    columns = [pa.array(np.arange(size)), pa.array(roots), pa.array(np.full(size, 100)), pa.array(sketches, pa.binary()), pa.array(list(halves), pa.list_(pa.int64()))]
    classes = pa.RecordBatch.from_arrays(columns, ["id", "root", "n", "sketch", "halves"])
    at = np.array([150, 151])
    asks = {"id": at, "root": np.array([150, 151]), "n": np.full(2, 100), "sketch": N._sketches(columns[3])[at], "halves": halves[at], "near": np.full(2, np.inf), "to": np.zeros(2, np.int64)}
    shared = type("Shared", (), {"value": (asks, np.array([203]), np.array([151]))})
    bits = np.bitwise_count(N._sketches(columns[3])).sum(1).astype(int)
    want = {a: sorted((abs(bits[a] - bits[b]), b) for b in range(100, 300) if (b % 10 if a == 150 else b not in (151, 203))) for a in (150, 151)}
    seen = {150: [], 151: []}
    for k in (1, 4, 16, 64, 256, 256):
        out = pa.Table.from_batches(N._following(shared, tables, k)([classes.slice(0, 220), classes.slice(220)]))
        for a, b, near, root in zip(*(c.to_pylist() for c in out.columns), strict=True):
            seen[a].append(b)
            assert root == (151 if b == 203 else roots[b])
            asks["near"][a - 150], asks["to"][a - 150] = near, b
    assert out.num_rows == 0 and seen == {a: [b for _, b in x] for a, x in want.items()}


def test_different_texts_of_one_document(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text + " x"), (2, "other words here"), (3, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted(map(tuple, N.near_duplicates(docs.repartition(1), 2).collect()))
    assert first == sorted(map(tuple, N.near_duplicates(docs.repartition(4), 2).collect()))


def test_halves_collide_as_planned():
    rng = np.random.default_rng(1)
    hits = 0
    tables = N.Tables.of(80)
    assert (tables.halves, tables.values, tables.least) == (14, 3, 4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
        a, b = x[:810], x[90:900]  # similarity 0.8
        keys = N.half_keys(np.concatenate([a, b]), np.array([0, len(a)]), tables)
        same = keys[0] == keys[1]
        hits += same[:14].any() and same[14:].any()
    assert hits >= 298


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(docs).count() == 0 and N.drop_near(docs).count() == 0
