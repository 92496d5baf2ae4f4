"""A toxicity classifier that identity terms must not sway: counterfactual-regularised logistic regression."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.llm import kernels
from docvet.llm.shared import Scratch

#: Labelled rows that the classifier is fitted on, at most, chosen by a hash of doc_id; features that it may use. Their number
#: and BALANCE were chosen by folds of rows that may teach (crc32 mod 3 is 0 against 2), never by held-out ones.
SAMPLE_ROWS, FEATURES = 20_000, 512
#: A feature must be in so many sample texts.
LEAST_TEXTS = 3
#: Weights of the penalty on changed scores and of the weights' squares; rounds and step of the fit.
COUNTERFACTUAL, SQUARES, ROUNDS, STEP = 1.0, 1e-5, 400, 0.1
#: The toxic rows' share of the loss: they are few.
BALANCE = 0.5
THRESHOLD = 0.7

#: Identity terms that are swapped for each other.
PAIRS = [
    ("men", "women"), ("man", "woman"), ("male", "female"), ("boys", "girls"), ("boy", "girl"), ("husband", "wife"), ("christian", "muslim"), ("christians", "muslims"), ("jew", "catholic"),
    ("jews", "catholics"), ("jewish", "protestant"), ("hindu", "buddhist"), ("atheist", "believer"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("black", "white"), ("african", "european"),
    ("asian", "american"), ("latino", "nordic"), ("immigrant", "native"), ("immigrants", "natives"), ("refugee", "citizen"), ("disabled", "healthy"), ("blind", "sighted"), ("deaf", "hearing"), ("old", "young"), ("mexican", "canadian"),
    ("männer", "frauen"), ("mann", "frau"), ("christen", "muslime"), ("juden", "katholiken"), ("schwule", "heteros"), ("ausländer", "inländer"), ("hommes", "femmes"), ("homme", "femme"),
    ("chrétiens", "musulmans"), ("juifs", "catholiques"), ("noirs", "blancs"), ("étrangers", "citoyens"), ("hombres", "mujeres"), ("hombre", "mujer"), ("cristianos", "musulmanes"), ("judíos", "católicos"), ("negros", "blancos"),
]
SWAP = {a: b for a, b in PAIRS} | {b: a for a, b in PAIRS}
_IDENTITY = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(SWAP, key=len, reverse=True)) + r")(?![^\W_])", re.I)

_APART = np.ones(256, bool)
_APART[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = False
_APART[128:] = False
#: Bytes of a word's beginning, and of its end, that are features beside the whole word.
HEADS, TAILS = (3, 4, 5, 6, 7), (4, 5)


def swapped(text: str | None) -> str | None:
    """text with each identity term replaced by its counterpart, or None where it has none."""
    out, n = _IDENTITY.subn(lambda m: SWAP[m[0].lower()], text or "")
    return out if n else None


def _folded(data: np.ndarray) -> np.ndarray:
    """A-Z and, in UTF-8, À-Þ in lower case."""
    data = kernels.lower(data)
    if len(data) > 1:
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
        data[latin] += 0x20
    return data


def _parts(column: pa.Array):
    """Parts of at most CHUNK bytes of the texts: first text, edges between texts, bytes, whether the text goes on."""
    data, offsets = kernels.texts_of(column)
    for i, j in kernels.spans_of(offsets):
        part = data[offsets[i] : offsets[j]]
        if len(part) <= kernels.CHUNK:
            yield i, (offsets[i + 1 : j] - offsets[i]).astype(np.int64), _folded(part), False
        else:
            for some in kernels.cut_at_spaces(part):
                yield i, np.zeros(0, np.int64), _folded(some), True
            yield i, np.zeros(0, np.int64), np.zeros(0, np.uint8), False


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    t, h = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return t[new], h[new]


def features(column: pa.Array, chosen: Chosen | None = None):
    """Yields (texts, hashes), distinct, for runs of texts: each word's whole, beginnings and ends; chosen: only those, as
    their places. A text's features come at once, so what is held is that of CHUNK bytes or of one longer text."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for i, edges, part, more in _parts(column):
        start, end = kernels.words(part, edges, _APART)
        text = i + np.searchsorted(edges, start, side="right")
        prefix = kernels.Prefix(part)
        size = end - start
        got = []
        for kind, n in [(0, 0), *((1, n) for n in HEADS), *((2, n) for n in TAILS)]:
            which = np.flatnonzero(size > n) if n else slice(None)
            s, e = start[which], end[which]
            h = prefix.of(e - n, e) if kind == 2 else prefix.of(s, s + n) if kind else prefix.of(s, e)
            h, t = kernels.mix(h + np.uint64(kind * 16 + n)), text[which]
            got.append(chosen.find(h, t)[::-1] if chosen is not None else (t, h))
        held.append(_distinct(got))
        if not more:
            yield _distinct(held) if len(held) > 1 else held[0]
            held = []


class Chosen:
    """The hashes that the classifier uses, sorted, with a table of their last bits that turns most others away."""

    BITS = 18

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[hashes & np.uint64((1 << self.BITS) - 1)] = True

    def find(self, h: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes, and texts, of those of h that are chosen."""
        maybe = np.flatnonzero(self.table[h & np.uint64((1 << self.BITS) - 1)])
        at = np.searchsorted(self.hashes, h[maybe])
        at = np.minimum(at, max(0, len(self.hashes) - 1))
        ok = self.hashes[at] == h[maybe] if len(self.hashes) else np.zeros(0, bool)
        return at[ok], t[maybe[ok]]

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (text, place) of the texts."""
        got = list(features(column, self)) if len(self.hashes) else []
        return tuple(np.concatenate([g[k] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64) for k in (0, 1))


def _counts(batches):
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for t, h in features(batch.column(0)):
            names, back = np.unique(h, return_inverse=True)
            texts, bad = np.bincount(back, minlength=len(names)), np.bincount(back, weights=toxic[t], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(texts.astype(np.int64)), pa.array(bad.astype(np.int64))], ["feature", "texts", "toxic"])


def _sample_rows(hashes: np.ndarray):
    def run(batches):
        chosen = Chosen(hashes)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            other = [swapped(t) for t in texts]
            cols = []
            for some in (batch.column(0), pa.array([x for x in other], pa.string())):
                t, f = chosen.rows(some)
                lists: list[list[int]] = [[] for _ in texts]
                for a, b in zip(t.tolist(), f.tolist(), strict=True):
                    lists[a].append(b)
                cols.append(lists)
            swaps = [y if x is not None else None for x, y in zip(other, cols[1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(cols[0], pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.int32()))], ["toxic", "own", "swap"])

    return run


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists)), n), np.array([f for x in lists for f in x], np.int64)


def fit(toxic: np.ndarray, own: list[list[int]], swap: list[list[int] | None], width: int, penalty: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression over presence of features. Beside the loss of the labels it lessens the
    mean squared change of the score, before the logistic function, between a text and itself with identity terms swapped."""
    n = len(toxic)
    share = float(np.mean(toxic)) if n else 0.0
    prior = float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))
    w, b = np.zeros(width), prior
    each = np.where(toxic > 0, BALANCE / max(share, 1e-9), (1 - BALANCE) / max(1 - share, 1e-9)) / max(n, 1)  # of a row's loss
    if not width or not 0 < share < 1:
        return w, b
    row, col = _flat(own)
    pairs = [k for k, s in enumerate(swap) if s is not None]
    prow, pcol = _flat([own[k] for k in pairs])
    qrow, qcol = _flat([swap[k] or [] for k in pairs])
    m = np.zeros((2, width + 1))
    for step in range(1, ROUNDS + 1):
        z = b + np.bincount(row, w[col], n)
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * each
        g = np.append(np.bincount(col, r[row], width) + SQUARES * w, r.sum())
        if pairs:
            d = (np.bincount(prow, w[pcol], len(pairs)) - np.bincount(qrow, w[qcol], len(pairs))) * (2 * penalty / len(pairs))
            g[:width] += np.bincount(pcol, d[prow], width) - np.bincount(qcol, d[qrow], width)
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.999 * m[1] + 0.001 * g * g
        move = STEP * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[:width]
        b -= move[width]
    return w, b


class Model:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        chosen = Chosen(self.hashes)
        t, f = chosen.rows(column)
        z = self.bias + np.bincount(t, self.weights[f], len(column)) if len(f) else np.full(len(column), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id=None):
    """Whether labels of the document are never learnt from: crc32 of doc_id as text, mod 3, is 1; null is not held out."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, penalty: float = COUNTERFACTUAL) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic): from SAMPLE_ROWS of the rows that aren't held out.

    Executors count features over the sample; those FEATURES whose share of toxic texts is farthest from the whole's, in
    standard deviations, and the sample's rows in them, come to the driver, which fits. Labels that are null or without
    document teach nothing, of different texts of one doc_id the smallest teaches, and a document that any label calls
    toxic is; without labels of both kinds the score is the same for every text.
    """
    with Scratch(docs.sparkSession) as tmp:
        taught = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        taught = tmp.stored(taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS), "taught")  # at most SAMPLE_ROWS short rows
        texts = docs.select("doc_id", "text").join(F.broadcast(taught.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
        sample = tmp.stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").repartition(6), "sample")
        n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not 0 < positive < n:
            return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((positive + 0.5) / (n - positive + 0.5))))
        p = positive / n
        counts = sample.mapInArrow(kernels.trimmed(_counts), "feature long, texts long, toxic long").groupBy("feature").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
        far = F.abs(F.col("toxic") - F.col("texts") * p) / F.sqrt(F.col("texts") * (p * (1 - p)))
        best = counts.filter(f"texts >= {LEAST_TEXTS}").orderBy(far.desc(), "feature").limit(FEATURES).select("feature").collect()
        hashes = np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))
        rows = sample.mapInArrow(kernels.trimmed(_sample_rows(hashes)), "toxic int, own array<int>, swap array<int>").collect()
    rows.sort(key=lambda r: (r.toxic, r.own))
    w, b = fit(np.array([r.toxic for r in rows], float), [r.own for r in rows], [r.swap for r in rows], len(hashes), penalty)
    return Model(hashes, w, b)


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            text = pc.struct_field(batch.column(0), "text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(text), pa.float64())], ["_doc", "_score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs as _doc, and their _score. Null and empty texts get the score of no features."""
    schema = ",".join(f"`{c}`:{t}" for c, t in docs.dtypes)
    return docs.select(F.struct(*docs.columns).alias("_doc")).mapInArrow(kernels.trimmed(_scorer(model)), f"_doc struct<{schema}>, _score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from THRESHOLD on). Only text makes the score."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    doc_id = F.col("_doc.doc_id")
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    return scored(docs, train(docs, labels)).filter(F.col("_score") < THRESHOLD).select("_doc.*")
