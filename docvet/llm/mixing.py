"""Interleaving sources in proportion to target weights by Pfair scheduling."""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.llm.shared import from_files, new_path, numbered

#: Rows of a block, the unit that is scheduled; blocks of a source in one row of the plan.
BLOCK_ROWS, PERIOD = 32, 1024
#: Blocks, of about 40 bytes, of a plan that is broadcast; beyond it the plan is written and joined by a shuffle.
BROADCAST_BLOCKS = 1_000_000


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratio of the weights; where all are 0, equal ones."""
    if not all(math.isfinite(w) and w >= 0 for w in weights):
        raise ValueError("weights must be finite and not negative")
    exact = [Fraction(w) for w in weights] if any(weights) else [Fraction(1)] * len(weights)
    d = math.lcm(*(x.denominator for x in exact))
    out = [int(x * d) for x in exact]
    return [x // math.gcd(*out) for x in out]


class Fluid:
    """The schedule that a Pfair one follows: every source gets its weight's exact share of each slot until it has no block
    left, and the others then share what it had. Its clock runs so that a source with weight c has j blocks done at j / c;
    until then, all sources together have done() of j / c, a whole number of c-ths."""

    def __init__(self, blocks: list[int], weights: list[int]):
        by = sorted(range(len(blocks)), key=lambda k: Fraction(blocks[k], weights[k]))
        self.ends = [(blocks[k], weights[k]) for k in by]
        self.over = [0, *itertools.accumulate(n for n, _ in self.ends)]  # blocks of the sources that end first
        self.rate = [*itertools.accumulate((c for _, c in reversed(self.ends)), initial=0)][::-1]  # weights of the others

    def ended(self, j: int, c: int, low: int = 0) -> int:
        """How many sources have ended at j / c; low: so many have for certain."""
        high = len(self.ends)
        if low < high and self.ends[low][0] * c > j * self.ends[low][1]:
            return low
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.ends[mid][0] * c <= j * self.ends[mid][1] else (low, mid)
        return low

    def before(self, j: int, c: int, ended: int) -> int:
        """Whole blocks that are done at j / c."""
        return self.over[ended] + j * self.rate[ended] // c

    def after(self, j: int, c: int, ended: int) -> int:
        """The same, rounded up."""
        return self.over[ended] - (-j * self.rate[ended] // c)


def pfair(blocks: list[int], weights: list[int]) -> list[array]:
    """The slots of each source's blocks, all slots from 0 without gaps. A block's window begins with the slot in which the
    fluid schedule begins it and ends with that in which it is done there; of the blocks whose window has begun the one whose
    window ends first goes first, of several the lower source's. As no more windows lie in any run of slots than it has
    slots, each block finds its place in its window."""
    fluid, slots, ended = Fluid(blocks, weights), [array("q") for _ in blocks], [0] * len(blocks)
    waiting = [(0, k) for k in range(len(blocks))]
    ready: list[tuple[int, int]] = []
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            _, k = heapq.heappop(waiting)
            j, c = len(slots[k]) + 1, weights[k]
            ended[k] = fluid.ended(j, c, ended[k])
            heapq.heappush(ready, (fluid.after(j, c, ended[k]), k))
        due, k = heapq.heappop(ready)
        assert t < due
        slots[k].append(t)
        if (j := len(slots[k])) < blocks[k]:
            heapq.heappush(waiting, (fluid.before(j, weights[k], ended[k]), k))
    return slots


def plan_rows(rows: list[int], weights: list[float], block_rows: int, period: int) -> Iterator[tuple]:
    """Of each source (by number) and each period of its blocks: source, number of the period, and of each block in it the
    phase, slot, release, deadline and the position of its first row. Sources of weight 0 come when all others have ended; a
    phase ends where a source does."""
    blocks = [-(-n // block_rows) for n in rows]
    groups, base, phase = [], 0, 0
    for some in ([k for k, w in enumerate(weights) if w], [k for k, w in enumerate(weights) if not w]):
        if some:
            n, c = [blocks[k] for k in some], whole([weights[k] for k in some])
            groups.append((some, n, c, base, phase, pfair(n, c)))
            base, phase = base + sum(n), phase + len(some)
    # A source's last block may lack rows; the blocks behind it begin earlier by as many.
    short = sorted((base + slots[i][-1], block_rows - rows[k] % block_rows) for some, _, _, base, _, slots in groups for i, k in enumerate(some) if rows[k] % block_rows)
    ends, lacking = [s for s, _ in short], [0, *itertools.accumulate(n for _, n in short)]
    for some, n, weights_, base, phase, slots in groups:
        fluid = Fluid(n, weights_)

        def each(i: int) -> Iterator[tuple]:
            c, begun, low = weights_[i], 0, base  # noqa: B023  used up before the next group
            for j, slot in enumerate(slots[i], 1):  # noqa: B023
                done = fluid.ended(j, c, begun)  # noqa: B023
                at = base + slot  # noqa: B023
                yield phase + begun, at, low, base + fluid.after(j, c, done), at * block_rows - lacking[bisect.bisect_left(ends, at)]  # noqa: B023
                begun, low = done, base + fluid.before(j, c, done)  # noqa: B023

        for i, k in enumerate(some):
            cells = each(i)
            for chunk in range(-(-blocks[k] // period)):
                yield k, chunk, *map(list, zip(*itertools.islice(cells, period), strict=True))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """One row per row of docs: doc_id, source, phase, block, slot, release, deadline, position.

    Each source's rows, in a fixed pseudo-random order, are cut into blocks of block_rows; the Pfair schedule deals slots
    to blocks so that after any number of slots a source is less than one block from its weight's exact share.
    The driver plans every block, in memory in proportion to their number; period is the number of blocks in one row of the
    plan and changes no result. weights: by source; a source that they don't name, null too, gets its row count to the given
    power (all sources where weights is None). When a source ends, the rest go on at their weights, so every row is placed
    exactly once. position numbers all rows from 0 without gaps in the order of the mix.
    Repeated rows are placed one by one; no documents give no rows.
    """
    return _placed(docs, ["doc_id", "source"], weights, power, block_rows, period).select("_doc.*", "phase", "block", "slot", "release", "deadline", "position")


def _placed(docs: DataFrame, carried: list[str], weights: dict[str | None, float] | None, power: float, block_rows: int, period: int) -> DataFrame:
    """mix() with the carried columns in the struct _doc."""
    spark = docs.sparkSession
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    rows = docs.select(F.struct(*carried).alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), named.alias("_src"))
    counts = sorted((r["_src"], r["count"]) for r in rows.groupBy("_src").count().collect())
    total = sum(n for _, n in counts)
    given = {("null" if k is None else f"={k}"): v for k, v in (weights or {}).items()}
    planned = plan_rows([n for _, n in counts], [given.get(s, n**power) for s, n in counts], block_rows, period)
    plan = _table(spark, [s for s, _ in counts], planned, sum(-(-n // block_rows) for _, n in counts), period)

    out = numbered(rows, "_src", ["_id", "_text"], "_row", total)
    out = out.withColumn("block", F.expr(f"_row div {block_rows}")).withColumn("_chunk", F.expr(f"block div {period}")).join(plan, ["_src", "_chunk"])
    of = lambda name: F.expr(f"{name}[cast(block % {period} as int)]")
    return out.select(
        "_doc",
        of("_phases").alias("phase"),
        "block",
        of("_slots").alias("slot"),
        of("_releases").alias("release"),
        of("_deadlines").alias("deadline"),
        (of("_starts") + F.expr(f"_row % {block_rows}")).alias("position"),
    )


def _table(spark: SparkSession, names: list[str], planned: Iterator[tuple], blocks: int, period: int) -> DataFrame:
    """The plan's rows, broadcast if they have few blocks, else written a part at a time and joined by a shuffle."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("_src", pa.string()), ("_chunk", pa.int64()), ("_phases", pa.list_(pa.int32())), ("_slots", longs), ("_releases", longs), ("_deadlines", longs), ("_starts", longs)])

    def part(some: list[tuple]) -> DataFrame:
        cols = list(zip(*some, strict=True)) or [[]] * len(schema)
        return spark.createDataFrame(pa.table([pa.array([names[k] for k in cols[0]], pa.string()), *map(pa.array, cols[1:], schema.types[1:])], schema=schema))

    if blocks <= BROADCAST_BLOCKS:
        return F.broadcast(part(list(planned)))
    path = new_path(spark, "plan")
    while some := list(itertools.islice(planned, max(1, BROADCAST_BLOCKS // period))):
        part(some).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """The rows of docs, all columns, ranged and sorted by their position in the mix: files written from it follow the mix."""
    order = _placed(from_files(docs), docs.columns, weights, power, block_rows, period)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return order.select("_doc", "position").repartitionByRange(parts, "position").sortWithinPartitions("position").select("_doc.*")
