"""Token-ID output in patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id; every task encodes its range in order and writes segments, one row each with
the segment's bytes as a binary column, through Spark's own writer (so retries, commits and remote stores are its
matter). A segment is:

    magic "PFB1", ids in it (u64), documents (u32), blocks (u32)
    ids of each document (u32 x documents)
    block index: where each block starts, from the end of the index (u32 x (blocks + 1))
    blocks of 256 ids: minimum (u32), width in bits (u8), number of exceptions (u8), 2 bytes free,
        ids minus the minimum at that width (256 x width / 8 bytes, low bits first),
        positions of the exceptions (u8 each), their differences from the minimum (u32 each)

The width is what the 90th percentile of a block's differences needs; larger ones are exceptions. A segment knows how
many ids its shard has before it, and a one-row-a-shard table adds the shards before.

Cases: a null text is an empty one (its end id only); equal doc_ids follow each other in the order of their texts, a
null doc_id comes first; texts of any length stay whole, in one segment; an empty table gives no segment and no row;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK, PERCENTILE, SEGMENT_IDS = 256, 90, 1 << 18
#: Texts that the tokenizer must see whole: it and str.split don't agree on these control characters.
WHOLE = regex.compile("[\x1c-\x1f]")
MEMO = 800_000
#: A word of letters (of which none composes, and lower case is one to one), then punctuation without an apostrophe.
# The parts of a tokenizer file under which a text's ids are those of its words, as WordEncoder takes them.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "truncation": None, "padding": None,
}
SUSPECT = np.zeros(256, bool)
SUSPECT[[0x1C, 0x1D, 0x1E, 0x1F, ord("<")]] = True
STEM = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_HEAD = struct.Struct("<4sQII")


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One segment of the ids of documents of these lengths."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(1) if blocks else np.zeros(0, np.uint32)
    off = rows - low[:, None]
    width = np.frexp(off.astype(np.float64))[1].astype(np.uint8)  # exact: 32 bits fit a double
    at = -(-BLOCK * PERCENTILE // 100) - 1
    chosen = np.partition(width, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint8)
    patch = width > chosen[:, None]
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(chosen):
        of = np.flatnonzero(chosen == w)
        values = np.where(patch[of], 0, off[of])
        bits = np.empty((len(of), BLOCK, int(w)), np.uint8)
        for b in range(int(w)):
            bits[:, :, b] = values >> np.uint32(b) & np.uint32(1)
        packed = np.packbits(bits.reshape(len(of), -1), axis=1, bitorder="little")
        for k, i in enumerate(of):
            p = np.flatnonzero(patch[i])
            head = struct.pack("<IBBH", int(low[i]), int(w), len(p), 0)
            bodies[i] = head + packed[k].tobytes() + p.astype(np.uint8).tobytes() + off[i, p].astype("<u4").tobytes()
    index = np.zeros(blocks + 1, "<u4")
    np.cumsum([len(b) for b in bodies], out=index[1:])
    return b"".join([_HEAD.pack(b"PFB1", n, len(lengths), blocks), np.asarray(lengths, "<u4").tobytes(), index.tobytes(), *bodies])


def unpack(data: bytes, blocks: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of a segment's documents and its ids, or those of a run of blocks, which the index finds."""
    magic, n, docs, count = _HEAD.unpack_from(data)
    if magic != b"PFB1":
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    lengths = np.frombuffer(data, "<u4", docs, at)
    index = np.frombuffer(data, "<u4", count + 1, at + 4 * docs).astype(np.int64)
    base = at + 4 * docs + 4 * (count + 1)
    first, last, _ = (blocks or slice(None)).indices(count)
    raw = np.frombuffer(data, np.uint8)
    heads = base + index[first:last]
    low = np.array([struct.unpack_from("<I", data, h)[0] for h in heads], np.uint32)
    widths = raw[heads + 4]
    out = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(widths):
        of = np.flatnonzero(widths == w)
        size = BLOCK // 8 * int(w)
        if size:
            bits = np.unpackbits(raw[heads[of][:, None] + 8 + np.arange(size)], axis=1, bitorder="little").reshape(len(of), BLOCK, int(w))
            for b in range(int(w)):
                out[of] |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
    for i in np.flatnonzero(raw[heads + 5]):
        h, k = int(heads[i]), int(raw[heads[i] + 5])
        p = h + 8 + BLOCK // 8 * int(widths[i])
        out[i, raw[p : p + k]] = np.frombuffer(data, "<u4", k, p + k)
    ids = (out + low[:, None]).ravel()
    return lengths, ids[: min(n, last * BLOCK) - first * BLOCK]


class WordEncoder:
    """The library's ids of whole texts, by way of their words: this tokenizer drops white space, and no token spans
    it, so a text's ids are those of its words, which repeat. Special tokens, and control characters that count as white
    space only for one of the two, send a text to the library as it is; a file with other rules sends all of them.

    Words of letters with punctuation behind, the most of them, are two pre-tokens, and letters are lower-cased first: so
    what is remembered are lower-case stems and tails. Stems go to the library many at a time; each ends with the only
    id of it that ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = all(spec.get(k) == v for k, v in BY_WORDS.items()) and spec["model"].get("end_of_word_suffix") == "</w>"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = regex.compile("|".join([WHOLE.pattern, *map(regex.escape, special)]))
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> None:
        for i in range(0, len(stems), 5000):
            some = stems[i : i + 5000]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                flat, at = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.parts.update((w, flat[x:y]) for w, x, y in zip(some, at, at[1:]))
            else:
                self.parts.update(zip(some, self.raw(some)))

    def _learn(self, words: list[str]) -> None:
        parts, split = self.parts, STEM.fullmatch
        plain, odd = [], []
        for w in words:
            m = split(w)
            if m is None:
                odd.append(w)
            else:
                stem, tail = m.groups()
                plain.append((w, stem.lower(), tail))
        self._stems(list({stem for _, stem, _ in plain if stem not in parts}))
        tails = list({tail for _, _, tail in plain if tail not in parts})
        parts.update(zip(tails, self.raw(tails)))
        self.memo.update([(w, parts[stem] + parts[tail]) for w, stem, tail in plain])
        for i in range(0, len(odd), 20_000):
            self.memo.update(zip(odd[i : i + 20_000], self.raw(odd[i : i + 20_000])))
        if len(parts) > MEMO:
            self.parts = {"": b""} | {stem: parts[stem] for _, stem, _ in plain}

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts in one array, each text's followed by ``end``, and how many each has.

        Arrow splits the texts and numbers their distinct words; ids are looked up once for each of those and spread
        over the texts by position."""
        memo = self.memo
        column = pc.fill_null(column, "") if column.null_count else column
        if not self.by_words:
            rows = [np.append(np.frombuffer(x, "<u4"), np.uint32(end)) for x in self.raw(column.to_pylist())]
            return np.concatenate([np.zeros(0, np.uint32), *rows]), np.array([len(x) for x in rows], np.int64)
        apart = {i: text for i in self._odd_rows(column) if self.whole.search(text := column[i].as_py())}
        if apart:
            mask = np.zeros(len(column), bool)
            mask[list(apart)] = True
            column = pc.if_else(pa.array(mask), "", column)
        split = pc.utf8_split_whitespace(column)
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in words if w and w not in memo])
        memo[""] = b""
        ids = [memo[w] for w in words]
        if len(memo) > MEMO:  # frequent words are in any batch, so they stay
            self.memo = dict(zip(words, ids))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(size) - size
        code = numbered.indices.to_numpy()
        n = size[code]
        bounds = split.offsets.to_numpy().astype(np.int64)
        total = np.concatenate(([0], np.cumsum(n)))
        lengths = total[bounds[1:]] - total[bounds[:-1]] + 1
        ends = np.cumsum(lengths)
        out = np.full(int(ends[-1]) if len(ends) else 0, end, np.uint32)
        for lo in range(0, len(lengths), 256):  # bounds the memory of positions
            hi = min(lo + 256, len(lengths))
            w0, w1 = bounds[lo], bounds[hi]
            take = np.repeat(first[code[w0:w1]] - (total[w0:w1] - total[w0]), n[w0:w1])
            tokens = flat[take + np.arange(len(take))]
            into = np.ones(int(ends[hi - 1] - ends[lo] + lengths[lo]), bool)
            into[ends[lo:hi] - 1 - (ends[lo] - lengths[lo])] = False
            out[ends[lo] - lengths[lo] : ends[hi - 1]][into] = tokens
        if apart:
            parts = np.split(out, ends[:-1])
            for i, text in apart.items():
                parts[i] = np.append(np.frombuffer(self.raw([text])[0], "<u4"), np.uint32(end))
                lengths[i] = len(parts[i])
            out = np.concatenate(parts)
        return out, lengths

    @staticmethod
    def _odd_rows(column: pa.Array) -> list[int]:
        """Rows that may hold a control character or the start of a special token."""
        rows = []
        for lo, _, raw, offsets in common.text_slices(column, 4 << 20):
            hit = np.flatnonzero(SUSPECT[raw])
            if len(hit):
                rows += (np.unique(np.searchsorted(offsets, hit, "right") - 1) + lo).tolist()
        return rows


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, in ascending order of ids, and write its ids as segments under ``path``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        cache = common.worker_cache("tokens", mapped=32 << 20)  # it has memory to spare, and mapping takes time
        encoder = cache.get(tokenizer)
        if encoder is None:
            encoder = cache[tokenizer] = WordEncoder(tokenizer)
        before = segment = 0
        for batch in batches:
            for lo, hi, _, _ in common.text_slices(batch.column(1), 8 << 20):
                with common.no_cycles():
                    flat, lengths = encoder.encode(batch.column(1).slice(lo, hi - lo), end)
                ends = np.cumsum(lengths)
                first = 0
                while first < len(lengths):
                    base = int(ends[first] - lengths[first])
                    last = max(first + 1, int(np.searchsorted(ends, base + SEGMENT_IDS, "right")))
                    ids = flat[base : ends[last - 1]]
                    keys = batch.column(0).slice(lo + first, last - first)
                    yield pa.record_batch({
                        "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                        "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "data": pa.array([pack(ids, lengths[first:last])], pa.binary()),
                    })
                    before, segment, first = before + len(ids), segment + 1, last

    schema = "shard int, segment int, before long, n_ids long, doc_ids array<long>, data binary"
    with common.wider_batches(docs.sparkSession):
        docs.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Read the segments under ``path`` back: doc_id, start, n_tokens and ids (array<int>), or with ``digest`` their
    ids_crc32 instead. Every shard's first place comes from a table with one row a task of the writer, which bounds what
    is broadcast."""
    schema = "shard int, segment int, before long, n_ids long, doc_ids array<long>, data binary"
    files = spark.read.schema(schema).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = shards.select("shard", ahead.alias("first"))
    rows = files.join(F.broadcast(first), "shard").select((F.col("first") + F.col("before")).alias("at"), "doc_ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, ids = unpack(batch.column(2)[i].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                out = {
                    "doc_id": batch.column(1)[i].values, "start": pa.array(starts + batch.column(0)[i].as_py()), "n_tokens": pa.array(lengths.astype(np.int64)),
                }
                if digest:
                    ids = np.ascontiguousarray(ids, "<u4")
                    out["ids_crc32"] = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())
                else:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch(out)

    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text of ``documents``, write the ids in ascending doc_id order, read the files back."""
    import public_tokenizers

    path = common.scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_tokens(spark, path, digest=True)
