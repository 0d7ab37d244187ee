"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of word shingles are compared as distinct values. Correlated bits are grouped into partitions; for each
fingerprint, dynamic programming over estimated candidate counts allots every partition its own threshold (-1: not
probed), so that the thresholds plus one add up to more than the radius: then any fingerprint within the radius agrees
with it on some probed partition within that partition's threshold. Probes meet the bucket they name, pairs are verified
on all bits, and a bucket hands on no more links than it has rows, namely a spanning forest of its true links.

Where links must also have a Jaccard similarity, fingerprints only propose: texts of one shingle set are one node, nodes
whose fingerprints are equal or linked, or that share a band of minima of their shingle hashes, fall into one cluster, and
within a cluster all pairs are verified in blocks before any forest is formed. No pair of a cluster goes untested.

Cases: a null text has no words and, like a blank one, fingerprint zero; texts of fewer words than a shingle are one
shingle; repeated rows and equal texts share a fingerprint; doc_id null takes part, and a group of only null ids has
component_id null; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64
from .components import connected_components

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Rows of a bucket that meet in one task at a time, on either side.
BUCKET_BLOCK = 2048
PROBE_COST = 8.0  # of one probe, in candidate pairs
#: Bands of minima and minima a band: sets of Jaccard similarity J share none with probability (1 - J**5)**24, which is
#: 0.00007 at 0.8. Rows of a cluster that meet in one task at a time, on either side.
BANDS, BAND_ROWS = 24, 5
CLUSTER_BLOCK = 512


def _bit_counts(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of hashes, how many have each of the 64 bits set: eight byte-wide counters a word, over pieces of at most
    255 hashes, which can't overflow."""
    pieces = -(-sizes // 255)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = starts[owner] + 255 * nth
    first = np.cumsum(pieces) - pieces
    out = np.empty((len(sizes), 8, 8), np.int64)
    ones = U64(0x0101010101010101)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> U64(k)) & ones, at)
        out[:, :, k] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(len(sizes), 64)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of the texts in a byte buffer, row after row, and their number in each row."""
    if lower:
        raw = LOWER[raw]
    starts, ends, first = common.word_bounds(raw, offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64)
    space = common.IS_SPACE[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]
    place = np.concatenate(([0], np.cumsum(keep)))
    text = np.where(space, np.uint8(0x20), raw)[keep].tobytes()
    starts, ends = place[starts], place[ends]
    n_words = np.diff(first)
    n = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(n)), n)
    index = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(index + words, first[owner + 1]) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[s:e], 42) for s, e in zip(starts[index].tolist(), ends[last].tolist())), U64, len(index)), n


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, words: int, bits: int) -> np.ndarray:
    """Fingerprints (rows x bits/64, unsigned 64-bit) of the texts in a byte buffer."""
    return _folded(*shingle_hashes(raw, offsets, words), bits)


def _folded(hashes: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """The majority of each bit over every row's hashes, repeats included."""
    out = np.zeros((len(n), bits // 64), U64)
    held = np.flatnonzero(n)
    if not len(held):
        return out
    size = n[held]
    begin = np.cumsum(size) - size
    for lane in range(bits // 64):
        h = hashes if not lane else common.mix64(hashes + U64(lane * 0x9E3779B97F4A7C15 % 2**64))
        over = 2 * _bit_counts(h, begin, size) > size[:, None]
        out[held, lane] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(doc_id, text_hash, fp binary) for every row; fp is a run of big-endian 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("simhash")
        for batch in batches:
            for lo, hi, raw, offsets in common.text_slices(batch.column(1)):
                made = fingerprints_of(raw, offsets, words, bits)
                wide = [r.tobytes() for r in made.astype(">u8")]
                yield pa.record_batch({"doc_id": batch.column(0).slice(lo, hi - lo), "text_hash": batch.column(2).slice(lo, hi - lo), "fp": pa.array(wide, pa.binary())})

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, fp binary")


def _matrix(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(U64).reshape(-1, bits // 64)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def group_bits(distinct: DataFrame, bits: int, parts: int) -> list[list[int]]:
    """Partitions of equal width. Bits join the partition whose bits they agree with most (by absolute correlation over
    all fingerprints); co-occurrence counts are summed over the table, bits * bits numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bits, bits))
        n = 0
        for batch in batches:
            x = _bits(_matrix(batch.column(0), bits)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.record_batch({"i": np.arange(bits * bits), "n": total.ravel().astype(np.int64)})
        yield pa.record_batch({"i": np.array([bits * bits]), "n": np.array([n])})

    rows = distinct.select("fp").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(bits * bits + 1)
    for r in rows:
        flat[r.i] = r.n
    n = max(flat[-1], 1.0)
    both = flat[:-1].reshape(bits, bits) / n
    rate = np.diag(both)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    near = np.abs(both - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    free, groups = set(range(bits)), []
    for p in range(parts):
        width = len(free) // (parts - p)
        left = sorted(free)
        seed = left[int(near[np.ix_(left, left)].sum(1).argmax())]
        group = [seed]
        free.discard(seed)
        while len(group) < width:
            left = sorted(free)
            nxt = left[int(near[np.ix_(left, group)].sum(1).argmax())]
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def part_values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The bits of each partition as one number (rows x partitions)."""
    bits = _bits(fps)
    return np.stack([bits[:, g].astype(np.int64) @ (np.int64(1) << np.arange(len(g), dtype=np.int64)) for g in groups], 1)


def allot(counts: np.ndarray, widths: list[int], mean: np.ndarray, total: int, most: int) -> np.ndarray:
    """Thresholds (-1..most) for every row and partition that add up to ``total``, of least estimated cost.

    The cost of threshold e is that of its probes plus the candidates expected: the bucket's own count, and for buckets
    up to e flips away the partition's mean count. Dynamic programming runs over partitions and the sum so far.
    """
    n, m = counts.shape
    levels = range(-1, most + 1)
    low, high = -m, m * most
    best = np.full((n, high - low + 1), np.inf)
    best[:, -low] = 0.0
    choice = []
    for i in range(m):
        nxt = np.full_like(best, np.inf)
        took = np.zeros(best.shape, np.int8)
        for e in levels:
            if e < 0:
                cost = np.zeros(n)
            else:
                probes = sum(math.comb(widths[i], d) for d in range(e + 1))
                cost = counts[:, i] + (probes - 1) * mean[i] + PROBE_COST * probes
            for s in range(low, high + 1):
                t = s - e
                if low <= t <= high:
                    new = best[:, t - low] + cost
                    better = new < nxt[:, s - low]
                    nxt[better, s - low] = new[better]
                    took[better, s - low] = e
        best = nxt
        choice.append(took)
    out = np.zeros((n, m), np.int8)
    at = np.full(n, total - low)
    for i in reversed(range(m)):
        out[:, i] = choice[i][np.arange(n), at]
        at = at - out[:, i]
    return out


def _flips(width: int, e: int) -> np.ndarray:
    """Masks of up to ``e`` set bits."""
    masks = [0]
    layer = [(0, 0)]
    for _ in range(e):
        layer = [(m | 1 << b, b + 1) for m, lo in layer for b in range(lo, width)]
        masks += [m for m, _ in layer]
    return np.array(masks, np.int64)


def _forest(a: np.ndarray, b: np.ndarray, n: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of links between rows 0..n-1, those of a spanning forest (fewer than n), of the closest rows if told how far
    they are apart."""
    if len(a) <= 1:
        return a, b
    if apart is not None:
        order = np.argsort(apart, kind="stable")
        a, b = a[order], b[order]
    root = list(range(n))
    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return a[kept], b[kept]


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int32)


def _bucket_links(fps: np.ndarray, role: np.ndarray, starts: np.ndarray, accept: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between probing (role 2) and indexed (role 1) rows of each bucket (buckets are runs of rows), as a spanning
    forest of the rows."""
    found_a, found_b, n = [], [], 0
    bounds = np.append(starts, len(fps))
    sizes = np.diff(bounds)
    small = sizes <= 64

    def add(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal n, found_a, found_b
        if len(a):
            found_a.append(a)
            found_b.append(b)
            n += len(a)
            if n > 1_000_000:
                x, y = forest()
                found_a, found_b, n = [x], [y], 0

    def forest() -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return _forest(a, b, len(fps), _distance(fps[a], fps[b]))

    def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (role[a] >= 2) & (role[b] % 2 == 1) & ~((role[a] == 3) & (role[b] == 3) & (a >= b))

    for size in np.unique(sizes[small & (sizes > 1)]):
        at = bounds[:-1][sizes == size]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(size), np.arange(size), indexing="ij"))
        step = max(1, 500_000 // len(i))
        for lo in range(0, len(at), step):
            a = (at[lo : lo + step, None] + i).ravel()
            b = (at[lo : lo + step, None] + j).ravel()
            go = allowed(a, b)
            a, b = a[go], b[go]
            apart = _distance(fps[a], fps[b])
            near = (apart <= accept) & (apart > 0)
            add(a[near], b[near])
    for k in np.flatnonzero(~small):
        rows = np.arange(bounds[k], bounds[k + 1])
        p, q = rows[role[rows] >= 2], rows[role[rows] % 2 == 1]
        for lo in range(0, len(p), 128):
            apart = _distance(fps[p[lo : lo + 128], None], fps[None, q])
            x, y = np.nonzero((apart <= accept) & (apart > 0))
            a, b = p[lo : lo + 128][x], q[y]
            go = allowed(a, b)
            add(a[go], b[go])
    if not found_a:
        none = np.zeros(0, np.int64)
        return none, none
    return forest()


def similar_fingerprints(distinct: DataFrame, bits: int, radius: int, accept: int | None = None, parts: int = 3, most: int = 2) -> DataFrame:
    """Links (a, b: fingerprints as binary) that connect all pairs of distinct fingerprints within ``radius`` bits; links
    of up to ``accept`` bits (by default the radius) count where a probe meets them."""
    accept = radius if accept is None else accept
    groups = group_bits(distinct, bits, parts)
    widths = [len(g) for g in groups]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("simhash")
        for batch in batches:
            values = part_values(_matrix(batch.column(0), bits), groups)
            for i in range(parts):
                yield pa.record_batch({"part": np.full(len(values), i, np.int32), "value": values[:, i], "fp": batch.column(0)})

    index = distinct.select("fp").mapInArrow(keys, "part int, value long, fp binary")
    sizes = common.materialize(index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")), "buckets")
    total = sizes.filter("part = 0").agg(F.sum("n").alias("n")).first().n or 0
    mean = np.array([total / 2.0**w for w in widths])
    counted = index.join(sizes, ["part", "value"]).groupBy("fp").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("n"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("simhash")
        for batch in batches:
            fps = _matrix(batch.column(0), bits)
            counts = np.array([[n for _, n in sorted(row)] for row in batch.column(1).to_pylist()], float).reshape(-1, parts)
            values = part_values(fps, groups)
            allowed = allot(counts, widths, mean, radius - parts + 1, most)
            for i in range(parts):
                role = np.where(allowed[:, i] >= 0, 3, 1).astype(np.int32)
                yield pa.record_batch({"part": np.full(len(fps), i, np.int32), "value": values[:, i], "fp": batch.column(0), "role": role})
                for e in range(1, most + 1):
                    rows = np.flatnonzero(allowed[:, i] == e)
                    masks = _flips(widths[i], e)[1:]
                    for lo in range(0, len(rows), 2000):
                        some = rows[lo : lo + 2000]
                        value = (values[some, i][:, None] ^ masks[None, :]).ravel()
                        who = pa.array(np.repeat(some, len(masks)))
                        yield pa.record_batch({"part": np.full(len(value), i, np.int32), "value": value, "fp": batch.column(0).take(who), "role": np.full(len(value), 2, np.int32)})

    rows = counted.mapInArrow(probe, "part int, value long, fp binary, role int").join(sizes, ["part", "value"])
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    as_probe = F.transform(every, lambda o: F.struct((mine * blocks + o).alias("cell"), F.lit(2).alias("role")))
    as_index = F.transform(every, lambda o: F.struct((o * blocks + mine).alias("cell"), F.lit(1).alias("role")))
    alone = F.array(F.struct(F.lit(0).alias("cell"), F.col("role")))
    cells = F.when(blocks == 1, alone).when(F.col("role") == 1, as_index).when(F.col("role") == 2, as_probe).otherwise(F.concat(as_probe, as_index))
    rows = rows.select("part", "value", "fp", F.explode(cells).alias("c")).select("part", "value", "c.cell", "fp", "c.role")
    dealt = rows.repartition("part", "value", "cell").sortWithinPartitions("part", "value", "cell")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("simhash")
        held: list[pa.RecordBatch] = []
        n = 0

        def work(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            table = pa.Table.from_batches(held)
            key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("part", "value", "cell")], 1)
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
            cut = len(key) if end else int(starts[-1])
            rest = table.slice(cut)
            held, n = rest.to_batches(), rest.num_rows
            if cut:
                done = table.slice(0, cut)
                column = done["fp"].combine_chunks()
                a, b = _bucket_links(_matrix(column, bits), done["role"].to_numpy(), starts[starts < cut], accept)
                yield pa.record_batch({"a": column.take(pa.array(a)), "b": column.take(pa.array(b))})

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 50_000:
                yield from work(False)
        if n:
            yield from work(True)

    return dealt.mapInArrow(verify, "a binary, b binary")


def _sets(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, ascending, row after row, and their number in each row."""
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.bincount(o[new], minlength=len(n))


def _bands(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each band of minima (rows x BANDS) of rows that all have hashes."""
    begin = np.cumsum(size) - size
    rng = np.random.Generator(np.random.PCG64(21))
    factors = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    shifts = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.int64).astype(U64)
    out = np.empty((len(size), BANDS), U64)
    for band in range(BANDS):
        key = np.full(len(size), band + 1, U64)
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            key = common.mix64(key * U64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(h * factors[k] + shifts[k], begin))
        out[:, band] = key
    return out


def _marked(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(doc_id, text_hash, fp, h1, h2, bands) for every row; h1 and h2 are 128 bits of hash of the shingle set, and a row
    without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("simhash")
        for batch in batches:
            for lo, hi, raw, offsets in common.text_slices(batch.column(1)):
                hashes, n = shingle_hashes(raw, offsets, words)
                wide = [r.tobytes() for r in _folded(hashes, n, bits).astype(">u8")]
                h, size = _sets(hashes, n)
                ends = np.cumsum(size)
                name = [xxhash.xxh3_128_digest(h[e - k : e].tobytes()) for e, k in zip(ends.tolist(), size.tolist())]
                name = np.frombuffer(b"".join(name), "<i8").reshape(-1, 2)
                bands = _bands(h, size[size > 0]).view(np.int64).ravel() if len(h) else np.zeros(0, np.int64)
                at = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))).astype(np.int32)
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(lo, hi - lo), "text_hash": batch.column(2).slice(lo, hi - lo), "fp": pa.array(wide, pa.binary()),
                    "h1": np.ascontiguousarray(name[:, 0]), "h2": np.ascontiguousarray(name[:, 1]), "bands": pa.ListArray.from_arrays(pa.array(at), pa.array(bands)),
                })

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, fp binary, h1 long, h2 long, bands array<long>")


def _jaccard_links(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets (ascending distinct hashes) of at least this Jaccard similarity: all pairs
    if all sets are on one side, else those across."""
    size = np.array([len(x) for x in sets], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    h, o = every[order], owner[order]
    column = np.cumsum(np.concatenate(([0], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    held = np.bincount(column)[column] > 1 if len(h) else np.zeros(0, bool)
    o, column = o[held], column[held]
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    shared = np.zeros((len(sets), len(sets)), np.float32)  # counts, exact below 2**24
    step = max(256, (1 << 20) // len(sets))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        first, last = np.searchsorted(column, [lo, lo + step])
        has = np.zeros((len(sets), min(step, int(column[-1]) + 1 - lo)), np.float32)
        has[o[first:last], column[first:last] - lo] = 1
        shared += has @ has.T
    both = shared.astype(np.float64)
    good = both >= similarity * (size[:, None] + size[None, :] - both)
    cross = side.any() and not side.all()
    good &= side[:, None] < side[None, :] if cross else np.triu(np.ones(good.shape, bool), 1)
    return _forest(*np.nonzero(good), len(sets))


def _proposed(marked: DataFrame, links: DataFrame) -> DataFrame:
    """(node, cluster) of the nodes that have company: by equal fingerprints, links of fingerprints, or a shared band."""
    fp_bucket = F.xxhash64(F.lit("fp"), "fp")
    buckets = marked.select("node", F.explode(F.concat(F.array(fp_bucket), "bands")).alias("bucket")).distinct()
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("__last")).filter("hub < __last").select("bucket", "hub")
    shared = buckets.join(hubs, "bucket").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    some = marked.groupBy("fp").agg(F.min("node").alias("node"))
    named = links.join(some.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(some.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    return connected_components(shared.union(named.select("x", "y"))).select("node", F.col("root").alias("cluster"))


def _shingle_sets(docs: DataFrame, marked: DataFrame, clusters: DataFrame, words: int) -> DataFrame:
    """(node, cluster, blocks, set) of the nodes of clusters; only one text a node is read."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / CLUSTER_BLOCK).cast("int")
    dealt = clusters.join(sizes, "cluster").select("node", "cluster", blocks.alias("blocks"))
    one = marked.join(dealt, "node").groupBy("node", "cluster", "blocks").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    one = one.select("node", "cluster", "blocks", F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"))
    texts = docs.join(one, docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["text_hash"] == F.col("__hash"))).dropDuplicates(["node"]).select("node", "text", "cluster", "blocks")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("simhash")
        for batch in batches:
            for lo, hi, raw, offsets in common.text_slices(batch.column(1)):
                h, size = _sets(*shingle_hashes(raw, offsets, words))
                ends = np.cumsum(size)
                made = [h[e - k : e].tobytes() for e, k in zip(ends.tolist(), size.tolist())]
                yield pa.record_batch({"node": batch.column(0).slice(lo, hi - lo), "cluster": batch.column(2).slice(lo, hi - lo), "blocks": batch.column(3).slice(lo, hi - lo), "set": pa.array(made, pa.binary())})

    return common.materialize(texts.mapInArrow(shingle, "node long, cluster long, blocks int, set binary"), "shingles")


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b: nodes) that connect all pairs within a cluster whose shingle sets have at least this Jaccard
    similarity. A large cluster is cut into blocks, and every two blocks meet."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j")))
    rows = sets.withColumn("mine", mine).select("node", "cluster", "mine", "set", F.explode(cell).alias("c"))
    rows = rows.select("cluster", "c.i", "c.j", (F.col("mine") == F.col("c.j")).alias("side"), "node", "set")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("simhash")
        key, node, side, held = None, [], [], []

        def work() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                a, b = _jaccard_links(held, np.array(side), similarity)
                ids = np.array(node, np.int64)
                if len(a):
                    yield pa.record_batch({"a": ids[a], "b": ids[b]})

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for k, (c, i, j, s, n) in enumerate(zip(*columns)):
                if key != (c, i, j):
                    yield from work()
                    key, node, side, held = (c, i, j), [], [], []
                node.append(n)
                side.append(s)
                held.append(np.frombuffer(batch.column(5)[k].as_py(), U64))
        yield from work()

    return rows.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 256, radius: int = 17, accept: int | None = 45, parts: int = 18, similarity: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) for every row of ``docs``: rows are in one component if a chain of
    links joins them. Without ``similarity`` links join fingerprints: every pair within ``radius`` bits, and wider ones, up
    to ``accept``, where they share a probed bucket. With ``similarity`` links join texts whose shingle sets have that
    Jaccard similarity; equal fingerprints alone join nothing.

    The defaults serve shingles of five words at a similarity of 0.8: with shingle sets of Jaccard similarity J the share
    of differing bits is near acos(2J / (1 + J)) / pi, which is 0.15 at 0.8; 45 of 256 bits are 0.18. Pairs beyond are
    proposed by the bands.
    """
    common.bound_batches(docs.sparkSession)
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    if similarity is not None:
        spark = docs.sparkSession
        raw = common.materialize(_marked(docs, words, bits), "fingerprints")
        names = common.materialize(raw.select("h1", "h2").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
        fps = common.materialize(raw.select("fp").distinct(), "classes")
        proposed = _proposed(raw.join(names, ["h1", "h2"]).drop("h1", "h2"), similar_fingerprints(fps, bits, radius, accept, parts))
        clusters = common.materialize(proposed, "clusters")
        common.release(fps)
        common.free_shuffles(spark)
        marked = raw.drop("bands").join(names, ["h1", "h2"]).drop("h1", "h2")
        sets = _shingle_sets(docs, marked, clusters, words)
        roots = connected_components(_verified(sets, similarity))
        common.release(sets, clusters)
        common.free_shuffles(spark)
        named = marked.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return named.join(least, "root").select("doc_id", "text_hash", "fp", "component_id", "root")
    marked = common.materialize(fingerprints(docs, words, bits), "fingerprints")
    classes = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = similar_fingerprints(classes, bits, radius, accept, parts)
    node = (lambda c: F.conv(F.hex(c), 16, -10).cast("long")) if bits <= 64 else F.col  # the fingerprints themselves
    roots = connected_components(links.select(node("a").alias("a"), node("b").alias("b")))
    named = classes.withColumn("node", node("fp")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = common.materialize(named.select("fp", "least", "root"), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of near duplicates, with all the columns of ``docs``: that of the least doc_id, ties by
    the text's hash; repeated rows count once."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("k"))
    kept = kept.select("k.doc_id", "k.text_hash").alias("k")
    mine = docs.select(common.packed_row(docs), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash")).alias("m")
    same = F.col("m.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("m.text_hash") == F.col("k.text_hash"))
    return mine.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*common.row_columns(docs.columns))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles over every whole text of ``documents``, linked at 2 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, words=3, bits=64, radius=2, accept=2, parts=3, similarity=None)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
