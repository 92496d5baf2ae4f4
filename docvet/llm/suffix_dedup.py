"""Bytes of repeated passages, found by merging Burrows-Wheeler transforms of shards of candidate strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.llm import kernels
from docvet.llm.shared import stored

#: Length of a repeated string; of the grams by which candidates are found.
WINDOW, GRAM = 50, 24
#: Bytes of texts in a chunk, the unit of work; anchors in a part. What is shuffled are rows of a chunk and a part, each of
#: about CHUNK_BYTES * PART_ANCHORS / (14 * input bytes) grams; where inputs are so large that these are few, raise both.
CHUNK_BYTES, PART_ANCHORS = 2 << 20, 600_000
#: Strings of a part that are merged at once; bytes of a shard of which one transform is made.
MERGED_STRINGS, SHARD_BYTES = 80_000, 1 << 18
NOBODY = np.iinfo(np.int64).max  # doc_id of documents without one: behind all others
END = 0xFF  # stands in no UTF-8 text

U8, U64, I64 = np.uint8, np.uint64, np.int64


# ---- transforms ----------------------------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int = 256) -> np.ndarray:
    """The suffixes of text in order, by doubling: ranks by 8 bytes, then 16, and so on until all differ or depth is met."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, U8)]).astype(U64)
    key = np.zeros(n, U64)
    for k in range(8):
        key = (key << U64(8)) | padded[k : n + k]
    size = 8
    while True:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, I64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        if size >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, I64)  # a suffix that ends is smallest
        after[: max(0, n - size)] = rank[size:] + 1
        key = (rank.astype(U64) << U64(32)) | after.astype(U64)
        size *= 2


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The two bytes before each suffix, in their order; before the first the last."""
    return (text[order - 2].astype(np.uint16) << np.uint16(8)) | text[order - 1]


def interleave(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms without sorting their suffixes: of each place in the merged order the shard, and whether the depth
    bytes from there are those of the place before. transforms hold the two bytes before each suffix; depth is even.

    Holt and McMillan's refinement, two bytes at a time: if the interleaving of the shards is right for prefixes of k bytes,
    then dealing its places in turn into one bucket for each two preceding bytes makes it right for k + 2. Places that no
    round has told apart have a common prefix of depth.
    """
    n = sum(map(len, transforms))
    flat = np.concatenate(transforms)
    kind = U8 if len(transforms) <= 256 else np.uint16 if len(transforms) <= 1 << 16 else np.uint32
    shard = np.repeat(np.arange(len(transforms), dtype=kind), [len(t) for t in transforms])
    block = np.zeros(n, np.int32)
    apart = np.zeros(n, bool)
    pair = np.empty(n, np.uint16)
    for _ in range(0, depth, 2):
        pair[np.argsort(shard, kind="stable")] = flat
        to = np.argsort(pair, kind="stable").astype(np.int32)
        shard = shard[to]
        sorted_, came = pair[to], block[to]
        apart[0] = True
        np.logical_or(sorted_[1:] != sorted_[:-1], came[1:] != came[:-1], out=apart[1:])
        block = np.cumsum(apart, dtype=np.int32)
        if block[-1] == n:
            break
    return shard, ~apart


def repeat_classes(texts: list[np.ndarray], depth: int) -> np.ndarray:
    """For every place of the shards' texts, one behind the other, the class of the depth bytes from there on: from the
    merged transforms, equal for places in one interval of common prefixes of at least depth."""
    orders = [suffix_order(t) for t in texts]
    shard, equal = interleave([transform(t, o) for t, o in zip(texts, orders, strict=True)], depth)
    place = np.empty(len(shard), I64)
    starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
    place[np.argsort(shard, kind="stable")] = np.concatenate([o + s for o, s in zip(orders, starts, strict=True)])
    out = np.empty(len(shard), I64)
    out[place] = np.cumsum(~equal)
    return out


# ---- candidates ----------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of the texts that end at ends in data: first window, number of windows, place of the gram in the first
    window, hash of the gram. Each window of WINDOW bytes belongs to the leftmost gram in it of least hash, so equal
    windows have equal grams at equal places, and successive windows mostly share theirs."""
    wide = WINDOW - GRAM + 1
    got: list[tuple] = []
    at, n = 0, len(data)
    while at + WINDOW <= n:
        part = data[at : at + kernels.CHUNK]
        m = len(part)
        prefix = kernels.Prefix(part)
        h = prefix.grams(GRAM)
        least = (h & ~U64((1 << 21) - 1)) | np.arange(len(h), dtype=U64)
        size = 1
        while 2 * size <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if wide > size:
            least = np.minimum(least[: size - wide], least[wide - size :])
        place = (least & U64((1 << 21) - 1)).astype(I64)
        a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, at + len(place))
        text_end = np.repeat(ends[a : b + 1], np.diff(np.concatenate([[at], ends[a:b], [at + len(place)]])))
        window = np.flatnonzero(np.arange(at, at + len(place)) + WINDOW <= text_end)
        place = place[window]
        if len(window):
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)]))
            count = np.diff(np.append(first, len(window)))
            lo = window[first]
            got.append((lo + at, count, place[first] - lo, h[place[first]], prefix.of(lo, lo + count + WINDOW - 1)))
        if at + m >= n:
            break
        at += m - WINDOW + 1
    if not got:
        return np.zeros(0, I64), np.zeros(0, I64), np.zeros(0, I64), np.zeros((2, 0), U64)
    lo, count, off, h, sig = (np.concatenate(x) for x in zip(*got, strict=True))
    return lo, count, off, np.stack([h, signed(sig, count, off)])


class Chunk:
    """The texts of a row of the chunk table, their anchors sorted by gram, and each anchor's part."""

    def __init__(self, docs: list, ends: list[int], data: bytes, parts: int):
        self.ids = docs
        self.ends = np.array(ends, I64)
        self.data = np.frombuffer(data, U8)
        lo, count, off, (h, sig) = anchors(self.data, self.ends)
        part = ((h >> U64(44)) % U64(parts)).astype(I64)
        order = np.argsort((part.astype(U64) << U64(44)) | (h & U64((1 << 44) - 1)), kind="stable")
        self.lo, self.count, self.off, self.h, self.sig, self.part = (x[order] for x in (lo, count, off, h, sig, part))
        known = np.array([NOBODY if d is None else d for d in docs], I64)
        self.doc = known[np.searchsorted(self.ends, self.lo, side="right")]
        self.grams = np.flatnonzero(_first(self.h))  # the first anchor of each gram

    def prints(self):
        """Yields (part, packed): five bytes of each distinct gram's hash in order; the last bit tells if several documents have it."""
        if not len(self.grams):
            return
        low, high = np.minimum.reduceat(self.doc, self.grams), np.maximum.reduceat(self.doc, self.grams)
        value = ((self.h[self.grams] & U64((1 << 39) - 1)) << U64(1)) | (low != high).astype(U64)
        packed = value.view(U8).reshape(-1, 8)[:, :5]
        part = self.part[self.grams]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            yield int(part[a]), packed[a:b].tobytes()

    def keep(self, masks: list[dict]) -> None:
        """Keeps only the anchors whose gram several documents have, as the parts' bits tell, and finds the entries: the
        distinct strings from an anchor's first window to the end of its last."""
        shared = np.zeros(len(self.grams), bool)
        part = self.part[self.grams]
        for m in masks:
            a, b = np.searchsorted(part, m["part"]), np.searchsorted(part, m["part"], side="right")
            shared[a:b] = np.unpackbits(np.frombuffer(m["bits"], U8), count=b - a).astype(bool)
        which = np.repeat(shared, np.diff(np.append(self.grams, len(self.h))))
        gram = (np.cumsum(which & _first(self.h)) - 1)[which]
        order = np.flatnonzero(which)[np.lexsort((self.sig[which], gram))]
        self.lo, self.count, self.off, self.h, self.sig, self.part, self.doc = (x[order] for x in (self.lo, self.count, self.off, self.h, self.sig, self.part, self.doc))
        new = np.concatenate([[True], (self.sig[1:] != self.sig[:-1]) | (self.h[1:] != self.h[:-1])]) if len(self.h) else np.zeros(0, bool)
        self.entries = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1

    def strings(self):
        """Yields (part, counts, places of the grams, least doc_ids, bytes) of the entries."""
        if not len(self.entries):
            return
        least = np.minimum.reduceat(self.doc, self.entries)
        lo, count, part = self.lo[self.entries], self.count[self.entries], self.part[self.entries]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            e = self.entries[a:b]
            text = self.data[_ranges(lo[a:b], count[a:b] + WINDOW - 1)]
            yield int(part[a]), count[a:b].astype(U8).tobytes(), _squeezed(self.off[e].astype(U8).tobytes()), _squeezed(least[a:b].tobytes()), _squeezed(text.tobytes())

    def removed(self, results: dict[int, bytes]) -> np.ndarray:
        """For each byte whether a window over it also starts in a document with a smaller doc_id."""
        step = np.zeros(len(self.data) + 1, np.int32)
        part = self.part[self.entries]
        for p, blob in results.items():
            a, b = np.searchsorted(part, p), np.searchsorted(part, p, side="right")
            runs, lens, docs = unpack_runs(blob, b - a)
            some = slice(*np.searchsorted(self.entry, [a, b]))
            e = self.entry[some] - a
            before = np.cumsum(runs) - runs
            r = _ranges(before[e], runs[e])
            within = np.cumsum(lens) - lens  # from the entry's first window
            within = within - np.repeat(within[before], runs) if len(runs) else within
            lo, doc = np.repeat(self.lo[some], runs[e]), np.repeat(self.doc[some], runs[e])
            gone = docs[r] < doc
            start = (lo + within[r])[gone]
            np.add.at(step, start, 1)
            np.add.at(step, start + lens[r][gone] + WINDOW - 1, -1)
        return np.cumsum(step[:-1]) > 0


def _first(x: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., count[0] numbers, then those of the next."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def pack_runs(runs: np.ndarray, lens: np.ndarray, docs: np.ndarray) -> bytes:
    return len(lens).to_bytes(8, "little") + _squeezed(runs.astype(U8).tobytes() + lens.astype(U8).tobytes() + docs.astype(I64).tobytes())


def unpack_runs(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = int.from_bytes(blob[:8], "little")
    data = _whole(blob[8:], n + 9 * m)
    return np.frombuffer(data, U8, n).astype(I64), np.frombuffer(data, U8, m, n).astype(I64), np.frombuffer(data, I64, m, n + m)


def named(text: np.ndarray, begin: np.ndarray, count: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the grams and of the whole strings that begin, one behind the other, at begin in text."""
    h, sig = np.empty((2, len(begin)), U64)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + kernels.CHUNK - 2 * WINDOW)))
        lo, end = begin[a:b] - begin[a], begin[a:b] - begin[a] + count[a:b] + WINDOW - 1
        prefix = kernels.Prefix(text[begin[a] : begin[a] + end[-1]])
        h[a:b] = prefix.of(lo + off[a:b], lo + off[a:b] + GRAM)
        sig[a:b] = signed(prefix.of(lo, end), count[a:b], off[a:b])
        a = b
    return h, sig


def signed(h: np.ndarray, count: np.ndarray, off: np.ndarray) -> np.ndarray:
    return kernels.mix(h + (count * 64 + off).astype(U64))


def solve(count: np.ndarray, off: np.ndarray, doc: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """least_docs() of a part's entries, a few grams at a time."""
    begin = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)
    h, sig = named(text, begin, count, off)
    pieces = max(1, -(-len(h) // MERGED_STRINGS))
    piece = (kernels.mix(h) % U64(pieces)).astype(I64)
    got = []
    for k in range(pieces):
        which = np.flatnonzero(piece == k)
        if len(which):
            got.append((which, *least_docs(h[which], sig[which], count[which], doc[which], text, begin[which])))
    runs = np.zeros(len(h), I64)
    for which, some, _, _ in got:
        runs[which] = some
    first = np.cumsum(runs) - runs
    lens, docs = np.empty((2, int(runs.sum())), I64)
    for which, some, n, d in got:
        into = _ranges(first[which], some)
        lens[into], docs[into] = n, d
    return runs, lens, docs


def least_docs(h: np.ndarray, sig: np.ndarray, count: np.ndarray, doc: np.ndarray, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per entry, a string that begins at begin in text, the number of runs of its windows with one least doc_id, the runs'
    lengths, those doc_ids.

    Equal strings of a gram are one with their least doc_id. A string that is the only one with its gram has no window in
    common with another. The strings of all other grams are cut into shards, transformed and merged; the windows of a
    class get the least doc_id of all strings that have one.
    """
    order = np.lexsort((sig, h))
    hs, ss = h[order], sig[order]
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])])
    string = np.empty(len(h), I64)
    string[order] = np.cumsum(new) - 1
    first = order[new]  # an entry of each string
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
    grams = np.cumsum(np.concatenate([[True], h[first][1:] != h[first][:-1]])) - 1
    several = np.bincount(grams)[grams] > 1
    n = count[first]
    window_doc = np.repeat(least, n)  # per window of each string
    if several.any():
        many = np.flatnonzero(several)
        size = n[many] + WINDOW - 1
        placed = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int((size + 1).sum()), END, U8)
        joined[_ranges(placed, size)] = text[_ranges(begin[first[many]], size)]
        shards = -(-len(joined) // SHARD_BYTES)
        cuts = np.unique(np.append(placed[np.linspace(0, len(placed), shards, endpoint=False).astype(int)], len(joined)))
        classes = repeat_classes([joined[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], WINDOW)
        of = classes[_ranges(placed, n[many])]
        into = _ranges((np.cumsum(n) - n)[many], n[many])
        by = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], of[by][1:] != of[by][:-1]]))
        best = np.minimum.reduceat(window_doc[into][by], starts)
        window_doc[into[by]] = np.repeat(best, np.diff(np.append(starts, len(by))))
    begins = np.zeros(len(window_doc), bool)
    begins[np.cumsum(n) - n] = True
    cut = begins | np.concatenate([[True], window_doc[1:] != window_doc[:-1]])
    at = np.flatnonzero(cut)
    runs = np.add.reduceat(cut.astype(I64), np.cumsum(n) - n)
    lens, docs = np.diff(np.append(at, len(window_doc))), window_doc[at]
    r = _ranges((np.cumsum(runs) - runs)[string], runs[string])
    return runs[string], lens[r], docs[r]


_CODEC = pa.Codec("zstd", compression_level=4)


# ---- tasks ---------------------------------------------------------------------------------------------------------------


def _squeezed(data: bytes) -> bytes:
    """Chunks and strings travel compressed: they are the bulk of what is written and shuffled."""
    return _CODEC.compress(data, asbytes=True) if data else b""


def _whole(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _to_chunks(batches):
    """Texts in rows of about CHUNK_BYTES; a longer text is a row by itself."""
    docs, ends, parts, size = [], [], [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([docs], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([_squeezed(b"".join(parts))], pa.binary())], ["docs", "ends", "data"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            text = text or b""
            if docs and size + len(text) > CHUNK_BYTES:
                yield row()
                docs, ends, parts, size = [], [], [], 0
            docs.append(doc)
            parts.append(text)
            size += len(text)
            ends.append(size)
    if docs:
        yield row()


def _chunks(batch: pa.RecordBatch, parts: int):
    for k in range(batch.num_rows):
        row = {name: batch.column(name)[k] for name in batch.schema.names}
        ends = row["ends"].as_py()
        yield row, Chunk(row["docs"].as_py(), ends, _whole(row["data"].as_py(), ends[-1]), parts)


def _prints(parts: int):
    def run(batches):
        for batch in batches:
            for row, chunk in _chunks(batch, parts):
                got = list(chunk.prints())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in got], pa.int32()), pa.array([row["chunk"].as_py()] * len(got), pa.int64()), pa.array([b for _, b in got], pa.binary())], ["part", "chunk", "prints"]
                )

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of the grams' prints of a part by chunk: bits that tell which are in several documents."""
    blobs = table.column("prints").to_pylist()
    n = np.array([len(b) // 5 for b in blobs])
    value = np.zeros((int(n.sum()), 8), U8)
    value[:, :5] = np.frombuffer(b"".join(blobs), U8).reshape(-1, 5)
    value = value.reshape(-1).view(U64)
    order = np.argsort(value >> U64(1), kind="stable")
    sorted_ = value[order]
    starts = np.flatnonzero(np.concatenate([[True], (sorted_[1:] >> U64(1)) != (sorted_[:-1] >> U64(1))]))
    sizes = np.diff(np.append(starts, len(value)))
    several = (sizes > 1) | (np.bitwise_or.reduceat(sorted_, starts) & U64(1)).astype(bool)
    shared = np.empty(len(value), bool)
    shared[order] = np.repeat(several, sizes)
    cuts = np.cumsum(n)[:-1]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(shared, cuts)], pa.binary())})


def _strings(parts: int):
    def run(batches):
        for batch in batches:
            for row, chunk in _chunks(batch, parts):
                chunk.keep(row["masks"].as_py() or [])
                got = list(chunk.strings())
                cols = list(zip(*got, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array([row["chunk"].as_py()] * len(got), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "chunk", "counts", "offs", "doc", "text"]
                )

    return run


def _solved(table: pa.Table) -> pa.Table:
    counts, offs, docs, texts = (table.column(c).to_pylist() for c in ("counts", "offs", "doc", "text"))
    n = [len(c) for c in counts]
    doc = np.frombuffer(b"".join(_whole(d, 8 * k) for d, k in zip(docs, n, strict=True)), I64)
    off = np.frombuffer(b"".join(_whole(o, k) for o, k in zip(offs, n, strict=True)), U8).astype(I64)
    text = np.frombuffer(b"".join(_whole(t, sum(c) + (WINDOW - 1) * len(c)) for t, c in zip(texts, counts, strict=True)), U8)
    runs, lens, least = solve(np.frombuffer(b"".join(counts), U8).astype(I64), off, doc, text)
    entry, run = np.cumsum([0, *n]), np.concatenate([[0], np.cumsum(runs)])
    blobs = [pack_runs(runs[a:b], lens[run[a] : run[b]], least[run[a] : run[b]]) for a, b in zip(entry[:-1], entry[1:], strict=True)]
    kernels.trim()
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "runs": pa.array(blobs, pa.binary())})


def _report(parts: int):
    def run(batches):
        for batch in batches:
            for row, chunk in _chunks(batch, parts):
                chunk.keep(row["masks"].as_py() or [])
                gone = chunk.removed({r["part"]: r["runs"] for r in row["results"].as_py() or []})
                out: list[list] = [[], [], [], [], []]
                start = 0
                for doc, end in zip(chunk.ids, chunk.ends.tolist(), strict=True):
                    g = gone[start:end]
                    out[0].append(doc)
                    out[1].append(end - start)
                    out[2].append(int(g.sum()))
                    out[3].append(int((g[1:] & ~g[:-1]).sum() + (g[:1].sum())))
                    out[4].append(chunk.data[start:end][~g].tobytes())
                    start = end
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, joined).

    Texts are UTF-8 bytes, null an empty one. A byte goes if a string of WINDOW bytes over it, within its text, also starts
    in a document with a smaller doc_id; strings are those of the input. A null doc_id counts as larger than all others;
    rows that repeat a doc_id don't take bytes from each other. Texts under WINDOW bytes stay whole.

    1. Texts are written as chunks. Each window belongs to one gram in it (anchors); hashes of the chunks' distinct grams
       meet in parts by hash, and bits tell every chunk which of its grams several documents have. No repeat lies elsewhere.
    2. The strings around those anchors, of each chunk the distinct ones with their least doc_id, meet by part. There they
       are shards of a collection: each shard's Burrows-Wheeler transform is made, the transforms are merged by interleave
       refinement, and intervals of common prefixes of WINDOW bytes give every window the least doc_id that has it.
    3. Chunks look their windows up and take bytes out.
    A part's size is fixed, their number grows with the input. A gram that is everywhere comes to its part once per chunk
    with each of the strings around it there. The written tables stay until the driver ends.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernels.trimmed(_to_chunks), "docs array<long>, ends array<long>, data binary")
    chunks = stored(rows.select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")
    size = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    parts = max(8, -(-size * 2 // (WINDOW - GRAM + 2) // PART_ANCHORS))

    masks = stored(chunks.mapInArrow(kernels.trimmed(_prints(parts)), "part int, chunk long, prints binary").groupBy("part").applyInArrow(_shared, "chunk long, part int, bits binary"), "masks")
    by_chunk = masks.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("masks"))
    fields = "part int, chunk long, counts binary, offs binary, doc binary, text binary"
    results = stored(
        chunks.join(by_chunk, "chunk", "left").mapInArrow(kernels.trimmed(_strings(parts)), fields).groupBy("part").applyInArrow(_solved, "chunk long, part int, runs binary"), "results"
    )
    solved = results.groupBy("chunk").agg(F.collect_list(F.struct("part", "runs")).alias("results"))
    found = chunks.join(by_chunk, "chunk", "left").join(solved, "chunk", "left")
    return found.mapInArrow(kernels.trimmed(_report(parts)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
