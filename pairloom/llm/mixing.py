"""Mixing sources to target weights by Pfair scheduling.

Every source's rows fall into blocks. The target is fluid: at every moment each source that has rows left receives its
weight's share among those that have, so that a source which runs out leaves its share to the rest in proportion. The
target begins and ends a source's i-th block (from 0) at times that are exact fractions; it may start at the slot that
holds the first and must be placed before the second, rounded up. Earliest deadline first among the released blocks meets
all deadlines, so that at every slot each source is less than one block from its target, over any length and for any
number of sources. The driver steps through the blocks in integer arithmetic and hands slots on in pieces, at most
``HELD`` at a time and what is incomplete of each source's last piece. Nothing is dropped.

Rows get their places without gathering a source anywhere: a source is hashed into buckets of about ``BUCKET_ROWS`` rows,
bucket counts give each bucket its first place, and rows are numbered within their bucket.

Cases: rows with a null source form a source of their own; sources without a weight, or of weight zero, share the least
positive weight given; repeated rows each get a place; an empty table gives an empty table; columns named like an output
are replaced by it.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Least rows of a hash bucket, blocks of a piece of the schedule, slots that the driver holds before they are written.
BUCKET_ROWS, PIECE, HELD = 1000, 256, 1 << 20


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of a period for each source: at least one, in proportion else, by largest remainders."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    given = {s: max(1, math.floor(x)) for s, x in exact.items()}
    left = period - sum(given.values())
    order = sorted(exact, key=lambda s: (-(exact[s] - given[s]), s))
    while left:
        for s in order if left > 0 else reversed(order):
            if not left:
                break
            if left > 0:
                given[s] += 1
                left -= 1
            elif given[s] > 1:
                given[s] -= 1
                left += 1
    return given


def schedule(given: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period: earliest deadline first among released blocks."""
    period = sum(given.values())
    releases: list[list[tuple[int, str, int]]] = [[] for _ in range(period)]
    for s, n in given.items():
        for i in range(n):
            releases[i * period // n].append((-(-(i + 1) * period // n), s, i))
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in given}
    for t in range(period):
        for job in releases[t]:
            heapq.heappush(ready, job)
        deadline, s, _ = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        out[s].append(t)
    return out


def fluid(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, phase) slot by slot; phase is the number of moments up to the block's start at which the target
    lets sources run out."""
    exact = {s: Fraction(weights[s]) for s, b in blocks.items() if b > 0}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    # Until the target has given i / w to each source still there, it has used the blocks of those gone and that much of
    # the active weight; between ends this is linear.
    ends = sorted({Fraction(blocks[s], w) for s, w in whole.items()})
    gone, active = [0] * (len(ends) + 1), [0] * (len(ends) + 1)
    for s, w in whole.items():
        k = bisect.bisect_left(ends, Fraction(blocks[s], w)) + 1
        gone[k] += blocks[s]
        active[k] -= w
    active[0] = sum(whole.values())
    for k in range(1, len(gone)):
        gone[k] += gone[k - 1]
        active[k] += active[k - 1]

    def window(s: str, i: int, k: int) -> tuple[int, int, int]:
        """First slot, slot before which block ``i`` must be placed, and phase, which is ``k`` or more."""
        w = whole[s]
        while k < len(ends) and ends[k].numerator * w <= i * ends[k].denominator:
            k += 1
        last = k
        while last < len(ends) and ends[last].numerator * w < (i + 1) * ends[last].denominator:
            last += 1
        return gone[k] + active[k] * i // w, gone[last] - (-active[last] * (i + 1) // w), k

    waiting: list[tuple[int, int, str, int, int]] = []
    for s in sorted(whole):
        first, deadline, k = window(s, 0, 0)
        waiting.append((first, deadline, s, 0, k))
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    for t in range(sum(blocks[s] for s in whole)):
        while waiting and waiting[0][0] <= t:
            _, deadline, s, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i, k))
        deadline, s, i, k = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        yield s, i, k
        if i + 1 < blocks[s]:
            first, deadline, later = window(s, i + 1, k)
            heapq.heappush(waiting, (first, deadline, s, i + 1, later))


def pieces(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int]) -> DataFrame:
    """The schedule as rows (__class, __piece, slots, phases) of ``PIECE`` blocks each."""
    kind = "__class string, __piece long, slots array<long>, phases array<int>"
    held: dict[str, tuple[list[int], list[int]]] = {}
    rows: list[tuple] = []
    path = None
    for t, (s, i, k) in enumerate(fluid(weights, blocks)):
        slots, phases = held.setdefault(s, ([], []))
        slots.append(t)
        phases.append(k)
        if len(slots) == PIECE or i + 1 == blocks[s]:
            rows.append((s, i // PIECE, *held.pop(s)))
        if len(rows) * PIECE >= HELD:
            path = path or common.scratch_path(spark, "mix")
            spark.createDataFrame(rows, kind).write.mode("append").parquet(path)
            rows = []
    if path is None:
        return F.broadcast(spark.createDataFrame(rows, kind))  # at most HELD slots
    if rows:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 16, source_col: str = "source", id_col: str = "doc_id", temperature: float = 0.5, key_cols: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with block (within the source), phase, slot (of the block in the mix) and place (of the row: ascending
    order is the mix). Without ``weights`` a source weighs its number of rows to the power ``temperature``.
    A row's place among its source's depends on the hash of ``key_cols``, by default all columns."""
    spark = docs.sparkSession
    added = ("block", "phase", "slot", "place", "__class", "__bucket", "__n")
    rest = [c for c in docs.columns if c not in added]
    name = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null"))
    counted = docs.groupBy(name.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.s: r.n for r in counted.collect()}  # one row a source
    if weights:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        weigh = {s: weights.get(s) or least for s in counts}
    else:
        weigh = {s: n**temperature for s, n in counts.items()}
    plans = pieces(spark, weigh, {s: -(-n // block_rows) for s, n in counts.items()})
    tagged = docs.select(*(F.col(f"`{c}`") for c in rest), name.alias("__class"))
    per = {s: max(BUCKET_ROWS, math.isqrt(n)) for s, n in counts.items()}  # neither buckets nor their rows grow faster than the root
    sizes = F.broadcast(spark.createDataFrame([(s, max(1, -(-n // per[s]))) for s, n in counts.items()], "__class string, __n long"))
    key = F.xxhash64(*(F.col(f"`{c}`") for c in key_cols or dict.fromkeys([id_col, *rest])))
    tagged = tagged.join(sizes, "__class").withColumn("__bucket", F.pmod(key, F.col("__n"))).drop("__n")
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = tagged.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("m")).select("__class", "__bucket", ahead.alias("__ahead"))
    nth = F.row_number().over(Window.partitionBy("__class", "__bucket").orderBy(key, F.col(f"`{id_col}`"))) - 1
    numbered = tagged.withColumn("__nth", nth).join(offsets, ["__class", "__bucket"]).withColumn("__at", F.col("__nth") + F.col("__ahead"))
    numbered = numbered.withColumn("block", F.expr(f"__at div {block_rows}"))
    placed = numbered.withColumn("__piece", F.expr(f"block div {PIECE}")).join(plans, ["__class", "__piece"])
    k = (F.col("block") % PIECE).cast("int")
    placed = placed.withColumn("slot", F.col("slots")[k]).withColumn("phase", F.col("phases")[k])
    return placed.select(*(F.col(f"`{c}`") for c in rest), "block", "phase", "slot", (F.col("slot") * block_rows + F.col("__at") % block_rows).alias("place"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all rows of ``documents`` with weights of the square roots of the sources' sizes, in blocks of 16 rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "block", "phase", "slot", "place")
