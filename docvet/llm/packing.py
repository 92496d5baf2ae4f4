"""Best-fit decreasing packing of tokenized documents into sequences of fixed capacity."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docvet.llm import kernels
from docvet.llm.shared import Scratch, few, file_starts, from_files, numbered, stored

CAPACITY = 2048
#: Words whose ids a Python worker remembers; of more, those stay that came in several chunks. It keeps fewer between tasks.
REMEMBERED_WORDS, KEPT_WORDS = 320_000, 100_000

#: file and row tell where the document lies, if that matters.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, file string, row long"
#: A document has fewer pieces: the tokens of 2 GiB of text, the most that a string holds.
MOST_PIECES = 1 << 21


#: Texts on which words and the whole tokenizer must agree.
PROBE = [
    "", " ", "  Two  spaces\tand\na\r\nline ", "THE Quick brown fox's co-operation, (e.g.) 3.14% of $1,000; a_b@c.d/e?f=g&h!", "ÄÖÜ äöüß ÉÈ naïve Straße İstanbul ǅ ﬁ ½ e\u0301 \u00a0x\u3000y",
    "日本語 текст ελληνικά 😀👍🏽 \u200bzero \ufeffmark", "don't CAN'T I'll we've 'quoted' \"double\" --- ... ?! a.b.c. x,y", "supercalifragilisticexpialidocious1234567890 0x1F 1e-9 aaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|> <|x", "word." * 5 + " end.", "cost$$$ (yes!) über*** olé!! ×!! ÷. naïveté's '' x''s _a_ ¿qué?", "a.", ".", "Hello!? ok: so; yes,",
]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """The ids of texts, from remembered ids of their words.

    The tokenizer lower-cases, and no token crosses white space, so a text's ids are those of its words in a row. A word
    of ASCII and lower-case Latin-1 letters needs no normalising and goes to the model alone; all others, and all words of
    a part that holds "<|", which begins the special tokens, go through the whole tokenizer. Whether that holds for the
    tokenizer of a file is tried on PROBE; where it doesn't, every text goes through the whole tokenizer.
    """

    PLAIN = re.compile("[a-zß-öø-ÿ]+")
    SIGNS = np.zeros(256, bool)
    SIGNS[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True
    ALNUM = np.zeros(256, bool)
    ALNUM[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.whole = Tokenizer.from_file(path or default_tokenizer())
        self.model = Tokenizer.from_file(path or default_tokenizer())
        self.model.normalizer = None
        self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()
        self.by_words = True
        want = [np.array(x.ids, np.uint32) for x in self.whole.encode_batch_fast(PROBE, add_special_tokens=False)]
        self.by_words = all(np.array_equal(a, b) for a, b in zip(want, self.texts(pa.array(PROBE)), strict=True))
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at, self.n, self.seen = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.used = 0

    def shrink(self, most: int) -> None:
        """Forgets all words but those that came in several chunks, and these too if they are more than most."""
        names = list(self.slot)  # in the order of their slots
        keep = np.flatnonzero(self.seen[: len(names)] > 1)
        keep = keep if len(keep) <= most else keep[:0]
        lens = self.n[keep]
        ids = self.ids[np.repeat(self.at[keep] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
        self.forget()
        self._put([names[k] for k in keep.tolist()], ids, lens)

    def _put(self, hashes: list[int], flat: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.slot) + len(hashes) > len(self.at):
            self.at, self.n, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.seen))
        k = len(self.slot)
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[k : k + len(hashes)] = self.used + np.cumsum(lens) - lens
        self.n[k : k + len(hashes)] = lens
        self.slot.update(zip(hashes, range(k, k + len(hashes)), strict=True))
        self.used += len(flat)

    def _learn(self, hashes: list[int], words: list[bytes]) -> None:
        texts = b" ".join(words).decode("utf-8", "replace").split(" ")
        plain = [k for k, t in enumerate(texts) if len(t) < 1000 and self.PLAIN.fullmatch(t)]
        for i in range(0, len(plain), 1024):
            some = plain[i : i + 1024]
            got = self.model.encode(" ".join([texts[k] for k in some]), add_special_tokens=False)
            self._put([hashes[k] for k in some], np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
        known = set(plain)
        if other := [k for k in range(len(texts)) if k not in known]:
            ids = [x.ids for x in self.whole.encode_batch_fast([texts[k] for k in other], add_special_tokens=False)]
            self._put([hashes[k] for k in other], np.array([x for w in ids for x in w], np.uint32), np.array([len(w) for w in ids], np.int64))

    def of(self, data: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a part of at most CHUNK bytes with edges between texts: the starts of its words, the bounds of their ids, the ids."""
        raw = data.tobytes()
        if b"<|" not in raw:
            data = kernels.lower(data)
            raw = data.tobytes()
        start, end = kernels.words(data, edges)
        if len(start) and b"<|" not in raw:
            # Signs at a word's end, behind a letter or digit, are tokens of their own.
            tail = (np.maximum.accumulate(np.where(self.SIGNS[data], -1, np.arange(len(data)))) + 1)[end - 1]
            last, before = data[np.maximum(tail - 1, 0)], data[np.maximum(tail - 2, 0)]
            latin = (before == 0xC3) & (last >= 0x9F) & (last <= 0xBF) & (last != 0xB7)
            split = (tail > start) & (tail < end) & (self.ALNUM[last] | (latin & (tail - 1 > start)))
            start = np.sort(np.concatenate([start, tail[split]]))
            end = np.sort(np.concatenate([end, tail[split]]))
        uniq, first, back = np.unique(kernels.Prefix(data).of(start, end), return_index=True, return_inverse=True)
        if len(self.slot) + len(uniq) > REMEMBERED_WORDS:
            self.shrink(REMEMBERED_WORDS // 2)
        names = uniq.tolist()
        slots = np.fromiter((self.slot.get(h, -1) for h in names), np.int64, len(names))
        if len(new := np.flatnonzero(slots < 0)):
            s, e = start[first[new]].tolist(), end[first[new]].tolist()
            self._learn([names[k] for k in new.tolist()], [raw[a:b] for a, b in zip(s, e, strict=True)])
            slots[new] = [self.slot[names[k]] for k in new.tolist()]
        self.seen[slots] += 1
        slots = slots[back]
        lens = self.n[slots]
        bounds = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=bounds[1:])
        ids = self.ids[np.repeat(self.at[slots] - bounds[:-1], lens) + np.arange(bounds[-1])]
        return start, bounds, ids

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not self.by_words:
            for text in column.to_pylist():
                yield np.array(self.whole.encode(text or "", add_special_tokens=False).ids, np.uint32)
            return
        data, offsets = kernels.texts_of(column)
        for i, j in kernels.spans_of(offsets):
            part = data[offsets[i] : offsets[j]]
            if j - i == 1 and len(part) > kernels.CHUNK:
                yield self.long(part)
                continue
            edges = (offsets[i + 1 : j] - offsets[i]).astype(np.int64)
            start, bounds, ids = self.of(part, edges)
            cuts = np.concatenate([[0], bounds[np.searchsorted(start, edges)], [len(ids)]])
            for k in range(j - i):
                yield ids[cuts[k] : cuts[k + 1]]

    def long(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text of any length; one with a word that isn't small beside CHUNK is tokenized whole."""
        gaps = np.flatnonzero(np.concatenate([[True], kernels.SPACE[data], [True]]))
        if np.diff(gaps).max() > kernels.CHUNK // 2:
            return np.array(self.whole.encode(data.tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return np.concatenate([self.of(part)[2] for part in kernels.cut_at_spaces(data)])


@functools.lru_cache(2)
def tokens_of(path: str | None) -> WordTokens:
    """One for each Python worker, kept while the worker serves further tasks."""
    return WordTokens(path)


def token_pieces(path: str | None, capacity: int):
    """For mapInArrow over doc_id, text, file and row: the pieces of each document's ids, an id 0 behind them."""

    def run(batches):
        tokens = tokens_of(path)
        for batch in batches:
            out: list[tuple] = []
            for k, ids in enumerate(tokens.texts(batch.column(1))):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    some = ids[at : at + capacity]
                    out.append((k, piece, at, len(some), zlib.crc32(some.tobytes())))
            k, *cols = list(zip(*out, strict=True)) or [[]] * 5
            doc, file, row = (batch.column(c).take(pa.array(k, pa.int64())) for c in (0, 2, 3))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), file, row], ["doc_id", "piece", "start", "length", "ids_crc32", "file", "row"])
        if len(tokens.slot) > KEPT_WORDS:
            tokens.shrink(KEPT_WORDS)

    return run


class OpenBins:
    """A segment tree over remaining capacities: which capacities have open bins, and those bins as runs (first, count)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.leaves, np.int64)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.tree[k] += n
            k >>= 1

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            self._add(room, count)

    def take(self, room: int) -> tuple[int, int]:
        first, count = self.runs[room].pop()
        self._add(room, -count)
        return first, count

    def tightest(self, length: int) -> int:
        """The least remaining capacity of at least length that an open bin has, or 0: up while only bins too full lie to
        the right, then down the leftmost way, in logarithmic time."""
        k = length + self.leaves
        if self.tree[k]:
            return length
        while k > 1 and (k & 1 or not self.tree[k + 1]):
            k >>= 1
        if k <= 1:
            return 0
        k += 1
        while k < self.leaves:
            k = 2 * k if self.tree[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] items of each length, with equal bins handled as one run.

    Returns (length, first item, end item, first bin, items of this length in each bin, offset of the first of them).
    An item goes to the tightest open bin; the next of the same length then finds that bin tightest as long as it fits, so
    a bin of room c takes c // length of them before another bin is touched.
    """
    bins, out, next_bin = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = bins.tightest(length)
            if room:
                first, count = bins.take(room)
            else:
                room, first, count = capacity, next_bin, -(-(n - done) // (capacity // length))
                next_bin += count
            each = min(room // length, n - done)
            used = min(count, (n - done) // each)
            out.append((length, done, done + used * each, first, each, capacity - room))
            done += used * each
            bins.put(room - each * length, first, used)
            bins.put(room, first + used, count - used)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ordered: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids, by the tokenizer file without special tokens, then id 0; null text counts as empty, so a
    document has at least one id. Documents longer than capacity are cut into pieces of capacity ids, the last shorter.
    All pieces of all documents are packed by one best-fit decreasing: since only lengths matter, the driver plans with the
    number of pieces of each length, of which there are at most capacity, and each piece takes the place of its rank
    among those of its length. Repeated rows are packed one by one. No documents: no rows.

    ordered: documents have an order, that of the rows in their files. Pieces of one length take their places in that order,
    and sequences are numbered in the order of their first pieces, so that a mix of sources goes on in the sequences.
    """
    spark = docs.sparkSession
    with Scratch(spark) as tmp:
        file, row = F.lit(None).cast("string"), F.lit(None).cast("long")
        if ordered:
            docs = from_files(docs)
            meta = docs.metadataColumn("_metadata")
            file, row = meta["file_path"], meta["row_index"]
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), file.alias("file"), row.alias("row"))
        pieces = tmp.stored(texts.mapInArrow(kernels.trimmed(token_pieces(tokenizer, capacity)), PIECES), "pieces")
        counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
        if ordered:  # the short rows of pieces meet those of files; texts are not moved
            starts = few(tmp.stored(file_starts(docs), "files"))
            pieces = pieces.join(starts, F.col("file") == F.col("_file")).withColumn("place", F.col("_first") + F.col("row")).drop("_file", "_first")
        pieces = pieces.drop("file", "row")
        plan: dict[int, list[tuple]] = {}
        for length, *rest in best_fit_decreasing(counts, capacity):
            plan.setdefault(length, []).append(tuple(rest))
        schema = "length long, _runs array<struct<first: long, end: long, bin: long, each: long, at: long>>"
        runs = F.broadcast(spark.createDataFrame(list(plan.items()), schema))
        order = ["place", "piece"] if ordered else ["doc_id", "piece", "start", "ids_crc32"]
        out = numbered(pieces, "length", order, "_rank", sum(counts.values()), F.col("place") if ordered else None).join(runs, "length")
        out = out.withColumn("_run", F.expr("filter(_runs, r -> _rank >= r.first and _rank < r.end)[0]"))
        placed = out.select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.expr("_run.bin + (_rank - _run.first) div _run.each").alias("sequence_id"),
            F.expr("_run.at + (_rank - _run.first) % _run.each * length").alias("offset"), *(["place"] if ordered else []),
        )
        if ordered:
            first = F.min(F.col("place") * MOST_PIECES + F.col("piece")).over(Window.partitionBy("sequence_id"))
            placed = placed.withColumn("_first", first).withColumn("sequence_id", F.col("_first")).drop("_first")
        return stored(placed.drop("place"), "packed")
