"""Exact substring deduplication by de Bruijn compaction of repeated word k-mers.

The graph's edges are the k-mers of ``window`` words, its nodes the ``window`` - 1 words that two edges share, so a window
is repeated exactly if its edge occurs more than once. Edges are kept as runs: the consecutive windows of a document that
have the same least ``KMER``-word piece (by hash, leftmost on a tie) make one row with a hash of all their words. A piece
found in one row only has no repeated edge. Where all rows of a piece hold the same words, the run as a whole is an arc of
the graph; else the graph may branch inside it, and one run of each content is opened into single edges. Arcs that occur
once are dropped, and edges whose neighbours in the runs are always the same are one arc from here on.

Compaction: traversals are counted for each pair of arcs that follow one another in a document. A node is passed without
branching if all occurrences of the arc before it go on to the arc after it, which has no others. Such arcs are linked,
and joins that double pointers (each arc points to the one twice as far back) give every arc the first arc of its
nonbranching path; what lies on a circle stays as it is. Each document then holds whole paths, known by the coordinates
of their first arcs. Hashes end here: at all its source coordinates every path's words are read again and their SHA-256
compared; where they differ, the windows there are told apart by SHA-256 one by one. Hashes that collide therefore remove
nothing; a repeat could only be missed if two different contents of one piece had equal 64-bit hashes.

Cases: a null text has no words; texts shorter than a window lose nothing; equal texts and repeated rows are repeats of
one another; doc_id may be null or repeated (rows are told apart by id and text); an empty table gives an empty table;
other columns, whatever their names, are carried along; texts and windows of any length are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import U64

#: Words of the pieces that name runs, and the most windows of a run (6 bits of an arc's number tell them).
KMER, MOST = 8, 60
_KMERS, _SPANS = common.Rolling(21), common.Rolling(22)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value, leftmost on a tie, in every run of ``width`` values."""
    at = np.arange(len(values))
    span = 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while span * 2 <= width:
        at = least(at[: len(at) - span], at[span:])
        span *= 2
    if span < width:
        off = width - span
        at = least(at[: len(at) - off], at[off:])
    return at


class Runs:
    """All windows of the texts in a byte buffer, as runs that share a least piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int):
        k = min(KMER, window)
        starts, ends, self.first = common.word_bounds(raw, offsets)
        words = common.word_hashes(raw, starts, ends)
        n = len(words)
        n_words = np.diff(self.first)
        self.rows = np.zeros(0, np.int64)
        if n < window:
            return
        pieces = _KMERS.prefix(words)
        at = np.arange(n - k + 1)
        piece = common.mix64(_KMERS.spans(pieces, at, at + k))
        least = _sliding_min(piece, window - k + 1)
        owner = np.repeat(np.arange(len(n_words)), n_words)
        begin = np.arange(n - window + 1)
        inside = owner[begin] == owner[begin + window - 1]
        begin, least = begin[inside], least[inside]
        if not len(begin):
            return
        part = (least - begin) // MOST  # where in its windows the piece stands, if that can be far apart
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (begin[1:] != begin[:-1] + 1) | (part[1:] != part[:-1])))
        head = np.flatnonzero(new)
        self.begin = begin[head]
        self.count = np.diff(np.append(head, len(begin)))
        self.rows = owner[self.begin]
        self.at = self.begin - self.first[self.rows]
        self.least = common.mix64(piece[least[head]] + part[head].astype(U64))
        self.content = _words_hash(_prefix(words), self.begin, self.begin + self.count - 1 + window)


def _prefix(words: np.ndarray) -> np.ndarray:
    return _SPANS.prefix(words)


def _words_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return common.mix64(_SPANS.spans(prefix, begin, end) + (end - begin).astype(U64))


def _arc(hashed: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """An arc's number: ``bits`` bits of its words' hash, and how many edges it holds."""
    return ((hashed >> U64(64 - bits)) << U64(6) | n.astype(U64)).view(np.int64)


RUNS = "doc_id long, text_hash long, at int, n short, kmer long, content long"


def runs(docs: DataFrame, window: int) -> DataFrame:
    """The runs of every document (columns doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("substrings")
        for batch in batches:
            for lo, hi, raw, offsets in common.text_slices(batch.column(2)):
                w = Runs(raw, offsets, window)
                if len(w.rows):
                    row = pa.array(w.rows + lo)
                    yield pa.record_batch({
                        "doc_id": batch.column(0).take(row), "text_hash": batch.column(1).take(row),
                        "at": pa.array(w.at, pa.int32()), "n": pa.array(w.count, pa.int16()),
                        "kmer": pa.array(w.least.view(np.int64)), "content": pa.array(w.content.view(np.int64)),
                    })

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, RUNS)


def _at_documents(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(text, doc_id, text_hash, list) of the documents that ``listed`` (doc_id, text_hash, list) names, once each."""
    a, b = docs.alias("a"), listed.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    held = a.join(b, same).select("a.text", "a.doc_id", "a.text_hash", "b.list")
    return held.dropDuplicates(["doc_id", "text_hash"])


def _opened(docs: DataFrame, contents: DataFrame, window: int, bits: int) -> DataFrame:
    """(kmer, content, times, arcs) of one run of each content: the run itself as one arc or, where the graph branches, its
    single edges in order, read from the document by coordinates."""
    listed = contents.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "n", "kmer", "content", "times", "branches")).alias("list"))
    held = _at_documents(docs, listed).select("text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("substrings")
        for batch in batches:
            for lo, hi, raw, offsets in common.text_slices(batch.column(0)):
                starts, ends, first = common.word_bounds(raw, offsets)
                spans = _prefix(common.word_hashes(raw, starts, ends))
                lists = batch.column(1).slice(lo, hi - lo)
                flat = lists.flatten()
                at, n, kmer, content, times, branches = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                row = np.repeat(np.arange(hi - lo), np.array([len(x) for x in lists], np.int64))
                edges = n.astype(np.int64)
                arcs = np.where(branches, edges, 1)
                each = np.repeat(np.arange(len(n)), arcs)
                j = np.arange(len(each)) - np.repeat(np.cumsum(arcs) - arcs, arcs)
                held = np.where(branches, 1, edges)[each]
                begin = first[row[each]] + at[each] + j
                made = _arc(_words_hash(spans, begin, begin + held - 1 + window), held, bits)
                place = np.concatenate(([0], np.cumsum(arcs))).astype(np.int32)
                yield pa.record_batch({"kmer": kmer, "content": content, "times": times, "arcs": pa.ListArray.from_arrays(pa.array(place), pa.array(made))})

    return held.mapInArrow(run, "kmer long, content long, times long, arcs array<long>")


def _segments(opened: DataFrame) -> DataFrame:
    """(kmer, content, j, arc, times): the repeated arcs of each content of ``opened`` (numbered by ``run``), edges that always follow one another made into one
    arc already here, where a content counts once, however many documents hold it."""
    none = F.lit(-1).cast("long")  # no arc's number
    step = F.transform("arcs", lambda x, i: F.struct(x.alias("arc"), F.when(i > 0, F.get("arcs", i - 1)).otherwise(none).alias("before"), F.coalesce(F.get("arcs", i + 1), none).alias("after")))
    rows = opened.select("run", "times", F.posexplode(step).alias("j", "s")).select("run", "times", "j", "s.*")
    known = rows.groupBy("arc").agg(F.sum("times").alias("t"), *(f(c).alias(f"{c}_{n}") for c in ("before", "after") for n, f in (("low", F.min), ("high", F.max)))).filter("t > 1")
    only = lambda c: F.when(F.col(f"{c}_low") == F.col(f"{c}_high"), F.col(f"{c}_low"))
    known = known.select("arc", "t", only("before").alias("prior"), only("after").alias("next"))
    inside = rows.select("run", "j", "arc", "before").join(known, "arc")
    order = Window.partitionBy("run").orderBy("j")
    goes_on = (F.col("prior") == F.col("before")) & (F.lag("arc").over(order) == F.col("before")) & (F.lag("next").over(order) == F.col("arc"))
    cut = inside.withColumn("starts", F.when(goes_on, 0).otherwise(1))
    cut = cut.withColumn("seg", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = cut.groupBy("run", "seg").agg(F.min(F.struct("j", "arc")).alias("first"), F.sum(_edges()).alias("n"), F.max("t").alias("times"))
    arc = F.col("first.arc").bitwiseAND(-64).bitwiseOR(F.col("n"))
    named = whole.select("run", F.col("first.j").alias("j"), arc.alias("arc"), "times").join(opened.select("run", "kmer", "content"), "run")
    return named.select("kmer", "content", "j", "arc", "times")


def _edges(arc: str = "arc"):
    return F.col(arc).bitwiseAND(63).cast("long")


def compact(arcs: DataFrame, passed: DataFrame) -> DataFrame:
    """(arc, root, off) for every arc: the first arc of its nonbranching path, and how many edges of the path precede it.
    ``arcs`` has arc, times; ``passed`` has before, after, n: how often one arc follows another. Pointers are doubled in
    joins until they reach the path's first arc; the arcs of circles, which never do, are paths of their own."""
    a = arcs.select(F.col("arc").alias("before"), F.col("times").alias("out"))
    b = arcs.select(F.col("arc").alias("after"), F.col("times").alias("into"))
    through = passed.filter("before <> after").join(a, "before").join(b, "after").filter("n = out and n = into")
    links = through.select(F.col("after").alias("arc"), F.col("before").alias("to"), _edges("before").alias("off"))
    state = arcs.select("arc").join(links, "arc", "left")
    state = state.select("arc", F.coalesce("to", "arc").alias("to"), F.coalesce("off", F.lit(0).cast("long")).alias("off"), F.col("to").isNull().alias("done"))
    made = [common.materialize(state, "pointers")]
    left = made[0].filter("not done").count()
    while left:
        known = made[-1]
        for older in made[:-1]:
            known = known.unionByName(older.filter("done"))
        onward = known.select(F.col("arc").alias("to"), F.col("to").alias("next"), F.col("off").alias("more"), "done")
        moved = made[-1].filter("not done").select("arc", "to", "off").join(onward, "to")
        made.append(common.materialize(moved.select("arc", F.col("next").alias("to"), (F.col("off") + F.col("more")).alias("off"), "done"), "pointers"))
        before, left = left, made[-1].filter("not done").count()
        if left == before:  # every round ends the arcs next to those that have ended: what is left goes round
            break
    root = F.when(F.col("done"), F.col("to")).otherwise(F.col("arc"))
    off = F.when(F.col("done"), F.col("off")).otherwise(0)
    whole = made[-1].select("arc", root.alias("root"), off.alias("off"))
    for older in made[:-1]:
        whole = whole.unionByName(older.filter("done").select("arc", F.col("to").alias("root"), "off"))
    labels = common.materialize(whole, "unitigs")
    common.release(*made)
    return labels


def repeated_paths(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """(doc_id, text_hash, at, n, root): where in a document a compacted repeated path of ``n`` edges starts."""
    found = runs(docs, window)
    again = found.groupBy("kmer").agg(F.count(F.lit(1)).alias("c"), F.min("content").alias("low"), F.max("content").alias("high"))
    again = again.filter("c > 1").select("kmer", (F.col("low") != F.col("high")).alias("branches"))
    shared = common.materialize(found.join(again, "kmer"), "runs")
    contents = shared.groupBy("kmer", "content", "branches").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "text_hash", "at", "n")).alias("k"))
    contents = contents.select("kmer", "content", "branches", "times", "k.*")
    common.free_shuffles(docs.sparkSession)
    opened = common.materialize(_opened(docs, contents, window, bits).withColumn("run", F.monotonically_increasing_id()), "arcs")
    common.free_shuffles(docs.sparkSession)
    inside = common.materialize(_segments(opened), "segments")
    common.release(opened)
    common.free_shuffles(docs.sparkSession)
    arcs = common.materialize(inside.groupBy("arc").agg(F.max("times").alias("times")), "repeated")
    placed = shared.join(inside.select("kmer", "content", "j", "arc"), ["kmer", "content"]).select("doc_id", "text_hash", (F.col("at") + F.col("j")).alias("at"), "arc")
    listed = placed.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("at", "arc"))).alias("list"))
    listed = common.materialize(listed, "traversals")
    common.free_shuffles(docs.sparkSession)
    steps = F.arrays_zip(F.slice("list", 1, F.greatest(F.size("list") - 1, F.lit(0))).alias("x"), F.slice("list", 2, F.size("list")).alias("y"))
    pairs = listed.filter(F.size("list") > 1).select(F.explode(steps).alias("s")).select("s.x", "s.y")
    pairs = pairs.filter(F.col("x.at") + _edges("x.arc") == F.col("y.at"))
    passed = pairs.groupBy(F.col("x.arc").alias("before"), F.col("y.arc").alias("after")).agg(F.count(F.lit(1)).alias("n"))
    labels = compact(arcs, passed)
    paths = labels.groupBy("root").agg(F.sum(_edges()).alias("n"))
    starts = listed.select("doc_id", "text_hash", F.explode("list").alias("s")).select("doc_id", "text_hash", "s.at", F.col("s.arc").alias("root"))
    starts = common.materialize(starts.join(paths, "root").select("doc_id", "text_hash", "at", "n", "root"), "paths")
    common.release(shared, inside, arcs, listed, labels)
    common.free_shuffles(docs.sparkSession)
    return starts


def covered(n: int, at: np.ndarray, edges: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in the spans of so many windows from these words on."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + edges + window - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(docs: DataFrame, paths: DataFrame, window: int, digest: bool) -> DataFrame:
    """(row, kept, n_words, n_removed, seen) of ``docs`` (row, doc_id, text_hash, text): the text without the words on
    paths, or its digest, and the SHA-256 (first half) of the words of every path."""
    marks = paths.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "n", "root")).alias("list"))
    a, b = docs.alias("a"), marks.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    joined = a.join(b, same, "left").select("a.row", "a.text", F.col("b.list.at").alias("at"), F.col("b.list.n").alias("n"), F.col("b.list.root").alias("root"))
    seen = T.ArrayType(T.StructType([T.StructField("root", T.LongType()), T.StructField("sha", T.BinaryType())]))
    out = T.StructType([joined.schema["row"]]).add("kept", "string").add("n_words", "long").add("n_removed", "long").add("seen", seen)
    sha = hashlib.sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("substrings")
        for batch in batches:
            for lo, hi, _, _ in common.text_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                made, counts, gone, read = [], [], [], []
                for text, at, n, root in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                    words = (text or "").encode().split()
                    kept, lost = words, 0
                    if at:
                        out_of = covered(len(words), np.array(at, np.int64), np.array(n, np.int64), window)
                        lost = int(out_of.sum())
                        kept = [w for w, x in zip(words, out_of.tolist()) if not x]
                        read.append([{"root": r, "sha": sha(b" ".join(words[i : i + m + window - 1])).digest()[:16]} for i, m, r in zip(at, n, root)])
                    else:
                        read.append([])
                    counts.append(len(words))
                    gone.append(lost)
                    made.append(sha(b" ".join(kept)).hexdigest() if digest else b" ".join(kept).decode() if lost else text)
                kind = pa.list_(pa.struct([("root", pa.int64()), ("sha", pa.binary())]))
                arrays = [part.column(0), pa.array(made, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(read, kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return joined.mapInArrow(run, out)


def _told_apart(docs: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """The windows of ``paths``, as paths of one edge, whose words (by SHA-256) start elsewhere too."""
    listed = paths.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "n")).alias("list"))
    rows = docs.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    schema = "doc_id long, text_hash long, at int, sha binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("substrings")
        for batch in batches:
            for text, doc, key, spans in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = (text or "").encode().split()
                starts = sorted({i for s in spans for i in range(s["at"], s["at"] + s["n"]) if i + window <= len(words)})
                made = [hashlib.sha256(b" ".join(words[i : i + window])).digest() for i in starts]
                each = len(starts)
                yield pa.record_batch({"doc_id": pa.array([doc] * each, pa.int64()), "text_hash": pa.array([key] * each, pa.int64()), "at": pa.array(starts, pa.int32()), "sha": pa.array(made, pa.binary())})

    told = common.materialize(_at_documents(docs, listed).mapInArrow(run, schema), "told")
    a, b = told.alias("a"), rows.alias("b")
    counted = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")))
    again = counted.groupBy("a.sha").agg(F.sum("b.rows").alias("c")).filter("c > 1").select("sha")
    return told.join(again, "sha").select("doc_id", "text_hash", "at", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("root"))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, hash_bits: int = 58) -> DataFrame:
    """``docs`` with every word removed that a repeated window covers; the kept words are joined by single spaces, texts
    that lose nothing stay as they are. Added: n_words, n_removed; with ``digest``, kept_sha256 (of the kept words)
    instead of the text. Columns of these names in the input give way. Arcs have ``hash_bits`` (at most 58) bits of their
    words' hash for a number; fewer only mean more work."""
    common.bound_batches(docs.sparkSession)
    made = "kept_sha256" if digest else text_col
    rest = [id_col] if digest else [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    text = F.col(f"`{text_col}`")
    keyed = docs.select(common.packed_row(docs, rest), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    paths = repeated_paths(keyed.select("doc_id", "text_hash", "text"), window, hash_bits)
    done = common.materialize(_removed(keyed, paths, window, digest), "removed")
    read = done.select(F.explode("seen").alias("s")).groupBy("s.root").agg(F.min("s.sha").alias("low"), F.max("s.sha").alias("high"))
    unlike = common.materialize(read.filter("low <> high").select("root"), "unlike")
    if not unlike.isEmpty():
        told = _told_apart(keyed, paths.join(unlike, "root", "left_semi"), window)
        paths = common.materialize(paths.join(unlike, "root", "left_anti").unionByName(told.select(*paths.columns)), "paths")
        done = common.materialize(_removed(keyed, paths, window, digest), "removed")
    common.release(paths)
    return done.select(*common.row_columns(rest), F.col("kept").alias(made), "n_words", "n_removed")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words of repeated 35-word windows from every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, window=35, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
starts as (select doc_id, i, array_to_string(list_slice(words, i, i + 34), ' ') as window_text from (select doc_id, words, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35)),
again as (select window_text from starts group by window_text having count(*) > 1),
gone as (select doc_id, i + k as at from (select s.doc_id, s.i from starts s join again a on a.window_text = s.window_text), (select unnest(range(0, 35)) as k) group by doc_id, i + k),
each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as at from w),
kept as (select e.doc_id, string_agg(e.word, ' ' order by e.at) as text from each e left join gone g on g.doc_id = e.doc_id and g.at = e.at where g.at is null group by e.doc_id),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, len(w.words)::bigint as n_words, coalesce(l.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from w left join lost l on l.doc_id = w.doc_id left join kept k on k.doc_id = w.doc_id
"""
