"""Shards of near equal bytes: the minimax contiguous partition of texts in hash order."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.llm.shared import Scratch, numbered, stored

#: The key's bits that the first, and each further, look at the group sizes tells apart.
FIRST_BITS, MORE_BITS = 14, 4


@dataclass
class Units:
    """Runs of groups in key order: the smallest key, the bits that the run's keys differ in, groups, bytes, largest group."""

    key: np.ndarray
    bits: np.ndarray
    groups: np.ndarray
    size: np.ndarray
    largest: np.ndarray

    def take(self, which: np.ndarray) -> Units:
        return Units(*(x[which] for x in (self.key, self.bits, self.groups, self.size, self.largest)))


def _look(groups: DataFrame, bits: int, within: tuple[int, list[int]] | None) -> Units:
    """The units of 2**bits keys; within: only those in the given cells of 2**within[0] keys."""
    if within:
        groups = groups.filter(F.shiftright("key", within[0]).isin(within[1]))
    rows = groups.groupBy(F.shiftright("key", bits).alias("cell")).agg(F.count("*"), F.sum("size"), F.max("size")).collect()
    a = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, 4)
    return Units(a[:, 0] << bits, np.where(a[:, 1] == 1, 0, bits), a[:, 1], a[:, 2], a[:, 3])


def _reach(ends: np.ndarray, start: int, capacity: int) -> int:
    """The number of units, counted from the first, that end within capacity bytes behind start."""
    return int(np.searchsorted(ends, start + capacity, side="right"))


def _cuts(ends: np.ndarray, capacity: int, shards: int, first: int = 0) -> list[int]:
    """The units at which shards end if each takes what it can."""
    cuts, at = [], first
    for _ in range(shards):
        at = _reach(ends, int(ends[at - 1]) if at else 0, capacity)
        cuts.append(at)
    return cuts


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which shards runs of whole units, each filled greedily, take all: found by binary search."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if _cuts(ends, mid, shards)[-1] == len(sizes):
            high = mid
        else:
            low = mid + 1
    return low


def even_cuts(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """First units of the shards but the first: no shard exceeds capacity, and each cut is as near to an even share of
    what is left as later shards allow."""
    ends, n, out, at = np.cumsum(sizes), len(sizes), [], 0
    for left in range(shards, 1, -1):
        base = int(ends[at - 1]) if at else 0
        far = _reach(ends, base, capacity)
        share = base + ((int(ends[-1]) if n else 0) - base) / left
        k = int(np.searchsorted(ends, share, side="left"))  # unit k holds the even cut
        near = k + 1 if k < n and ends[k] - share <= share - (ends[k - 1] if k else 0) else k
        to = min(max(near, at), far)
        while to < far and _cuts(ends, capacity, left - 1, to)[-1] < n:
            to += 1
        out.append(to)
        at = to
    return out


def plan(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """The first keys of the shards but the first, and the largest shard's bytes, least possible for the key order.

    groups: key long, size long. The driver first sees sizes summed over 2**14 ranges of keys. Bounds on the capacity, with
    ranges taken whole and taken as fluid, tell which ranges can hold a cut; only those are looked at more closely, until
    each such range is one group. What the driver holds thus doesn't grow with the number of groups but by a few rounds.
    """
    units = _look(groups, 64 - FIRST_BITS, None)
    if not len(units.key):
        return [], 0
    while True:
        ends = np.cumsum(units.size)
        low = max(int(units.largest.max()), -(-int(ends[-1]) // shards))
        high = smallest_capacity(units.size, shards)
        starts = ends - units.size
        open_ = np.zeros(len(ends), bool)
        for k, cut in enumerate(_cuts(ends, low, shards - 1), 1):
            least = int(ends[cut - 1]) if cut else 0
            open_ |= (ends >= least) & (starts <= k * high)
        open_ &= units.groups > 1
        if not open_.any() or low == high:
            break
        finer = [units.take(~open_)]
        for bits in np.unique(units.bits[open_]):
            cells = (units.key[open_ & (units.bits == bits)] >> bits).tolist()
            finer.append(_look(groups, max(0, int(bits) - MORE_BITS), (int(bits), cells)))
        units = Units(*(np.concatenate([getattr(x, f) for x in finer]) for f in ("key", "bits", "groups", "size", "largest")))
        units = units.take(np.argsort(units.key))
    capacity = smallest_capacity(units.size, shards)
    cuts = even_cuts(units.size, shards, capacity)
    return [int(units.key[c]) if c < len(units.key) else (1 << 63) - 1 for c in cuts], capacity


def minimax_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ("bytes"), shard (0 to shards - 1), slot, grown_shard (null).

    size is the text's UTF-8 bytes (null: none) plus 1. Equal texts, null and empty ones too, are one atomic group; groups
    lie in the order of a 64-bit hash of their text. The largest shard has the least bytes that contiguous cuts allow;
    below that, shards are as even as cuts allow. slot numbers a shard's rows from 0 without gaps. A group larger than an
    even share fills a shard by itself. Fewer groups than shards leave shards empty; no documents give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key")
    )
    with Scratch(docs.sparkSession) as tmp:
        rows = tmp.stored(rows, "sized")
        firsts, _ = plan(tmp.stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups"), shards)
        shard = F.lit(0)
        for first in firsts:
            shard = shard + (F.col("key") >= F.lit(first)).cast("int")
        out = numbered(rows.withColumn("shard", shard), "shard", ["doc_id", "key"], "slot", rows.count())
        return stored(out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), "shards")
