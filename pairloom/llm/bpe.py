"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words and their ids are compiled into a shared-suffix automaton whose transitions carry integer outputs: the
outputs along a word's path add up to the word's number, which points into one table of ids. The automaton is a flat
file, shared through the cluster's folder and memory-mapped by every Python worker. Words that it lacks are merged
exactly, pair by pair in rank order. The lexicon decides speed only; the ids are those of the tokenizers library.

Cases: a null text is an empty one and has no ids; special-token strings in a text become their id, as the library does;
repeated rows, ties and texts of any length are encoded row by row; an empty table gives an empty table; input columns
named like an output are replaced by it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# White space as Unicode's White_Space has it, and the pattern of the byte-level pre-tokenizer over it.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
SPACE_BEFORE_WHITE = regex.compile(rf" [{WHITE}]")

#: Words in the lexicon, and words whose counts one task holds at a time while it looks for frequent ones.
LEXICON_WORDS = 1 << 17
SKETCH_WORDS = 1 << 17
#: Marks two ids that don't merge.
NO_PAIR = np.int64(1 << 62)
#: Chunks whose ids a worker remembers before it starts anew; bytes of text that it encodes at a time.
MEMO, SLICE = 200_000, 4 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: its own if printable in Latin-1, else one from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """A byte-level BPE model read from a tokenizer's JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        cut = spec.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("not a byte-level tokenizer without normaliser, prefix space and post-processor")
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        self.single = [vocab[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        named = vocab | self.special
        self.pieces = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            self.pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.names, self.meanings = (pa.array(x, pa.binary()) for x in ([b"%d" % i for i in range(len(self.pieces))], self.pieces))
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.piece_memo: dict[str, bytes] = {}
        self.strange = "|".join([f" [{WHITE}]", *map(re.escape, self.special)])
        self.lexicon: Transducer | None = None
        self.ints = list(range(len(self.pieces)))
        self.single_ids = np.array(self.single, np.int32)
        pairs = sorted(self.merges.items())
        self.pair_keys = np.array([a << 32 | b for (a, b), _ in pairs] or [-1], np.int64)
        self.pair_made = np.array([r << 20 | i for _, (r, i) in pairs] or [NO_PAIR], np.int64)
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.byte_pairs = self._ranks(self.single_ids[a], self.single_ids[b]).reshape(256, 256)

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many words by exact merges, each step for all words at once: always a word's pair of least rank,
        leftmost first. Words of one length share a matrix; long words go one by one over a heap."""
        out: list[tuple[int, ...]] = [()] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            if n > 40:
                for r in rows:
                    out[r] = self._merge_long([self.single[b] for b in words[r]])
                continue
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                raw = np.frombuffer(b"".join([words[r] for r in part]), np.uint8).reshape(len(part), n)
                for r, ids in zip(part, self._merge_block(raw)):
                    out[r] = ids
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank * 2**20 + new id of pairs of ids; NO_PAIR where they don't merge."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_made[at], NO_PAIR)

    def _merge_block(self, raw: np.ndarray) -> list[tuple[int, ...]]:
        total, n = raw.shape
        out: list[tuple[int, ...]] = [()] * total
        ids = np.full((total, n + 1), -1, np.int32)
        ids[:, :n] = self.single_ids[raw]
        made = np.full((total, n), NO_PAIR, np.int64)
        made[:, : n - 1] = self.byte_pairs[raw[:, :-1], raw[:, 1:]]
        rows, columns = np.arange(total), np.arange(n)
        while len(rows):
            spot = made.argmin(1)
            each = np.arange(len(rows))
            best = made[each, spot]
            done = best == NO_PAIR
            if done.any():
                for r, line in zip(rows[done].tolist(), ids[done].tolist()):
                    out[r] = tuple(line[: line.index(-1)])
                go = ~done
                rows, ids, made, spot, best = rows[go], ids[go], made[go], spot[go], best[go]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            shift = columns[None, :] + (columns[None, :] > spot[:, None])
            ids[each, spot] = (best & 0xFFFFF).astype(np.int32)
            ids[:, :n] = np.take_along_axis(ids, shift, 1)
            made[:, : n - 1] = np.take_along_axis(made, np.minimum(shift, n - 1), 1)[:, : n - 1]
            made[:, n - 1] = NO_PAIR
            made[each, spot] = self._ranks(ids[each, spot], ids[each, np.minimum(spot + 1, n)])
            left = np.flatnonzero(spot > 0)
            made[left, spot[left] - 1] = self._ranks(ids[left, spot[left] - 1], ids[left, spot[left]])
        return out

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        n, rank_of = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := rank_of((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := rank_of((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := rank_of((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return tuple(x for x in ids if x >= 0)

    def ids_of(self, words: list[str], as_bytes: bool = False) -> dict:
        """Ids of distinct words (tuples, or bytes of 32-bit numbers): from the lexicon, else by exact merges."""
        raw = [w.encode("utf-8", "replace") for w in words]
        found = self.lexicon.find(raw, as_bytes) if self.lexicon is not None else [None] * len(raw)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.merge_all([raw[i] for i in unseen])):
            found[i] = array("i", ids).tobytes() if as_bytes else ids
        return dict(zip(words, found))

    def chunks(self, text: str) -> tuple[str, list[str]]:
        """Cut a text at single spaces into pieces that no word crosses: the first, and those that a space precedes.
        Where white space follows a space the cut could change the words, so such a text stays whole."""
        if SPACE_BEFORE_WHITE.search(text):
            return text, []
        first, *rest = text.split(" ")
        return first, rest

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Plain runs of a text, each with the special id that follows it, if any."""
        at = 0
        if self.cut is not None:
            for m in self.cut.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text. Pieces and words that the worker doesn't remember are looked up and merged together."""
        memo, find = self.memo, self.words.findall
        plans: list[list] = []
        pieces: set[str] = set()
        heads: set[str] = set()
        for text in texts:
            plan: list = []
            for plain, special in self.segments(text or ""):
                if plain:
                    first, rest = self.chunks(plain)
                    plan.append((words := find(first), rest))
                    heads.update(words)
                    pieces.update(p for p in rest if p not in memo)
                if special is not None:
                    plan.append(special)
            plans.append(plan)
        cut = {p: find(" " + p) for p in pieces}
        for words in cut.values():
            heads.update(words)
        known = self.ids_of(list(heads))
        shared = self.ints.__getitem__
        known = {w: tuple(map(shared, ids)) for w, ids in known.items()}  # one object for each id, however often it occurs
        fresh = {p: known[w[0]] if len(w) == 1 else tuple(i for x in w for i in known[x]) for p, w in cut.items()}
        out = []
        for plan in plans:
            ids: list[int] = []
            add = ids.extend
            for step in plan:
                if isinstance(step, int):
                    ids.append(step)
                    continue
                for w in step[0]:
                    add(known[w])
                for p in step[1]:
                    add(memo[p] if p in memo else fresh[p])
            out.append(ids)
        if len(memo) + len(fresh) > MEMO:
            memo.clear()
        memo.update((p, ids) for p, ids in fresh.items() if len(p) < 40)
        return out

    def piece_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, as bytes of 32-bit numbers; what the worker doesn't remember is cut into words, looked
        up and merged together."""
        memo, find = self.piece_memo, self.words.findall
        unseen = [p for p in pieces if p not in memo]
        if unseen:
            cut = [[p] if p.isascii() and p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else find(p) for p in unseen]
            known = self.ids_of(list({w for words in cut for w in words}), as_bytes=True)
            memo.update((p, known[w[0]] if len(w) == 1 else b"".join([known[x] for x in w])) for p, w in zip(unseen, cut))
        out = [memo[p] for p in pieces]
        if len(memo) > MEMO:  # frequent pieces are in any batch, so they stay
            self.piece_memo = {p: ids for p, ids in zip(pieces, out) if len(p) < 40}
        return out

    def encode_column(self, column: pa.Array) -> Encoded:
        """The ids of a column of texts. Arrow cuts the texts at single spaces and numbers the distinct pieces, which are looked
        up once each; texts with special tokens, or with white space after a space, where a cut could change the words,
        are encoded by themselves."""
        column = pc.fill_null(column, "") if column.null_count else column
        strange = pc.match_substring_regex(column, self.strange)
        apart = np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist()
        odd = dict(zip(apart, self.encode_all([column[i].as_py() for i in apart])))
        split = pc.split_pattern(pc.if_else(strange, "", column) if apart else column, " ")
        at = split.offsets.to_numpy().astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        codes, names = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary.to_pylist()
        table = self.piece_ids([" " + p for p in names])
        first = at[:-1][at[:-1] < at[1:]]
        heads = np.unique(codes[first])  # a text's first piece has no space before it
        table += self.piece_ids([names[c] for c in heads.tolist()])
        codes[first] = len(names) + np.searchsorted(heads, codes[first])
        return Encoded(self, codes, at - at[0], table, odd)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


class Encoded:
    """The ids of a column of texts. Most texts are runs of pieces, numbered by ``codes`` (text i holds those from ``at[i]`` to
    ``at[i + 1]``), and ``table`` has the ids of each distinct piece; the others have their ids in ``odd``."""

    def __init__(self, codec: Codec, codes: np.ndarray, at: np.ndarray, table: list[bytes], odd: dict[int, list[int]]):
        self.codec, self.codes, self.at, self.table, self.odd = codec, codes, at, table, odd
        self.sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4

    def lengths(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.sizes[self.codes])))
        out = total[self.at[1:]] - total[self.at[:-1]]
        for i, ids in self.odd.items():
            out[i] = len(ids)
        return out

    def ids(self) -> pa.ListArray:
        flat = np.frombuffer(b"".join(self.table), np.int32)
        first = np.cumsum(self.sizes) - self.sizes
        parts = []
        cuts = sorted({0, len(self.at) - 1, *range(0, len(self.at) - 1, 256), *self.odd, *(i + 1 for i in self.odd)})
        for lo, hi in zip(cuts, cuts[1:]):  # a few texts at a time, which bounds the memory of positions
            if lo in self.odd:
                parts.append(np.array(self.odd[lo], np.int32))
                continue
            codes = self.codes[self.at[lo] : self.at[hi]]
            n = self.sizes[codes]
            start = np.cumsum(n) - n
            parts.append(flat[np.repeat(first[codes] - start, n) + np.arange(int(n.sum()))])
        offsets = np.concatenate(([0], np.cumsum(self.lengths()))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))

    def _joined(self, names: pa.Array, between: bytes) -> list[bytes]:
        """Per text what its ids are called, in a row: joined for each distinct piece, then for each text; a piece without ids
        is passed over."""
        flat = np.frombuffer(b"".join(self.table), np.int32)
        ends = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int32)
        made = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(flat))), between)
        made = pc.if_else(pa.array(self.sizes == 0), None, made)
        lists = pa.ListArray.from_arrays(pa.array(self.at.astype(np.int32)), made.take(pa.array(self.codes)))
        return _join(lists, between).to_pylist()

    def decimals(self) -> list[bytes]:
        """Each text's ids as decimals, joined by commas."""
        out = self._joined(self.codec.names, b",")
        for i, ids in self.odd.items():
            out[i] = ",".join(map(str, ids)).encode()
        return out

    def decoded(self) -> list[str]:
        """The text of each text's ids: the bytes that every id stands for, in a row, read as UTF-8."""
        out = [x.decode("utf-8", "replace") for x in self._joined(self.codec.meanings, b"")]
        for i, ids in self.odd.items():
            out[i] = self.codec.decode(ids)
        return out


def _join(lists: pa.ListArray, between: bytes) -> pa.Array:
    """The values of each list in a row, nulls left out; an empty list gives an empty value."""
    flat, at = lists.values, lists.offsets.to_numpy()
    if flat.null_count:
        good = flat.is_valid().to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(good)))[at].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), flat.drop_null())
    return pc.binary_join(lists, between)


class Transducer:
    """Minimal acyclic transducer over byte strings, stored as one flat file.

    Layout: six 64-bit counts, then 32-bit arrays: transition keys (state * 256 + byte + 1, hashed, 0 = free), target
    states, outputs, whether a state is final, where a word's ids start, the ids.
    """

    @staticmethod
    def build(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
        """Compile sorted, distinct words. Equal suffixes share states, found through a register of state signatures."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, dict[int, int], int]] = []  # final, targets, words below

        def freeze(node: list) -> int:
            key = (node[0], *sorted(node[1].items()))
            if (found := register.get(key)) is None:
                found = register[key] = len(states)
                states.append((node[0], node[1], node[0] + sum(states[t][2] for t in node[1].values())))
            return found

        path: list[list] = [[False, {}]]
        last = b""
        for word, _ in entries:
            same = len(os.path.commonprefix([word, last]))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1][last[len(path) - 1]] = freeze(node)
            for _b in word[same:]:
                path.append([False, {}])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1][last[len(path) - 1]] = freeze(node)
        root = freeze(path[0])
        keys, targets, outputs = [], [], []
        for s, (final, to, _) in enumerate(states):
            number = int(final)
            for byte in sorted(to):
                keys.append(s * 256 + byte + 1)
                targets.append(to[byte])
                outputs.append(number)
                number += states[to[byte]][2]
        size = 1 << max(4, (2 * len(keys)).bit_length())
        table = np.zeros((3, size), np.uint32)
        for k, t, o in zip(keys, targets, outputs):
            at = (k * 2654435761 >> 7) & (size - 1)
            while table[0, at]:
                at = (at + 1) & (size - 1)
            table[:, at] = k, t, o
        finals = np.fromiter((s[0] for s in states), np.uint32, len(states))
        starts = np.cumsum([0] + [len(ids) for _, ids in entries]).astype(np.uint32)
        flat = np.fromiter((i for _, ids in entries for i in ids), np.uint32)
        head = np.array([size, len(states), len(entries), len(flat), root, 0], np.uint64)
        return b"".join(x.tobytes() for x in (head, table, finals, starts, flat))

    def __init__(self, data):
        view = memoryview(data)
        size, states, words, flat, self.root, _ = view[:48].cast("Q")
        self.mask = size - 1
        at = 48

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += 4 * n
            return np.frombuffer(view[at - 4 * n : at], np.uint32)

        self.keys, self.targets, self.outputs = take(size), take(size), take(size)
        self.finals, self.starts = take(states), take(words + 1)
        self.blob = bytes(view[at : at + 4 * flat])  # the ids of all words, as 32-bit numbers

    @classmethod
    def open(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes], as_bytes: bool = False) -> list:
        """The ids of each word, None where the lexicon lacks it; all words walk the automaton together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(lengths) - lengths
        state, number = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        alive, step = np.flatnonzero(lengths > 0), 0
        state[lengths == 0] = -1
        while len(alive):
            key = state[alive] * 256 + raw[start[alive] + step] + 1
            at = (key * 2654435761 >> 7) & self.mask
            open_ = np.arange(len(alive))
            while len(open_ := open_[(self.keys[at[open_]] != key[open_]) & (self.keys[at[open_]] != 0)]):
                at[open_] = (at[open_] + 1) & self.mask
            hit = self.keys[at] == key
            state[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            number[alive] += self.outputs[at]
            state[alive] = self.targets[at]
            step += 1
            alive = alive[lengths[alive] > step]
        good = (state >= 0) & (self.finals[state] > 0)
        out: list = [None] * n
        begin, end = self.starts[number[good]].tolist(), self.starts[number[good] + 1].tolist()
        blob = self.blob
        for i, a, b in zip(np.flatnonzero(good).tolist(), begin, end):
            out[i] = blob[4 * a : 4 * b]
        return out if as_bytes else [x if x is None else tuple(np.frombuffer(x, np.uint32).tolist()) for x in out]


def _prune(counts: Counter, keep: int) -> Counter:
    """Misra-Gries: take the (keep + 1)-th largest count off every count; whatever stays above zero is kept."""
    if len(counts) <= keep:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(values, len(values) - keep - 1)[len(values) - keep - 1])
    return Counter({w: c - off for w, c in counts.items() if c > off})


def frequent_words(docs: DataFrame, tokenizer_json: str, words: int = LEXICON_WORDS, text_col: str = "text") -> DataFrame:
    """About the ``words`` most frequent words of all texts, no more (word binary, n long). Every task sums its texts in a Misra-Gries
    summary of ``SKETCH_WORDS`` words, so what is shuffled is bounded by the number of tasks, whatever the vocabulary."""

    common.bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(tokenizer_json, None)
        chunks: Counter = Counter()
        found: Counter = Counter()

        def spread() -> None:
            find = codec.words.findall
            for chunk, n in chunks.items():
                for w in find(chunk):
                    found[w] += n
            chunks.clear()

        for batch in batches:
            for lo, hi, _, _ in common.text_slices(batch.column(0), SLICE):
                column = pc.fill_null(batch.column(0).slice(lo, hi - lo), "")
                strange = pc.match_substring_regex(column, codec.strange)
                for i in np.flatnonzero(strange.to_numpy(zero_copy_only=False)).tolist():
                    for plain, _ in codec.segments(column[i].as_py()):
                        first, rest = codec.chunks(plain)
                        chunks[first] += 1
                        chunks.update([" " + p for p in rest])
                split = pc.split_pattern(column.filter(pc.invert(strange)), " ")
                at, flat = split.offsets.to_numpy(), split.flatten()
                head = np.zeros(len(flat), bool)
                head[at[:-1][at[:-1] < at[1:]] - at[0]] = True
                for before, mask in ((" ", ~head), ("", head)):
                    counted = flat.filter(pa.array(mask)).value_counts()
                    for p, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                        chunks[before + p] += n
                if len(chunks) > SKETCH_WORDS:
                    spread()
                    if len(found) > 3 * SKETCH_WORDS:
                        found = _prune(found, SKETCH_WORDS)
        spread()
        found = _prune(found, SKETCH_WORDS)
        rows = found.most_common()
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.record_batch({"word": pa.array([w.encode("utf-8", "replace") for w, _ in part], pa.binary()), "n": pa.array([n for _, n in part], pa.int64())})

    summed = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    summed = common.materialize(summed.filter(F.length("word") <= 64), "words")
    # counts in steps of an eighth of a power of 2: all steps that fit, and of the next one a share of its words by hash
    step = F.floor(F.log2("n") * 8).cast("int")
    room, chosen = words, F.lit(False)
    for r in sorted(summed.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True):  # at most 512 rows
        if r.c > room:
            chosen |= (step == r.s) & (F.xxhash64("word").bitwiseAND((1 << 62) - 1) < int(0.95 * room / r.c * (1 << 62)))
            break
        room, chosen = room - r.c, step >= r.s
    return summed.filter(chosen)


def build_lexicon(docs: DataFrame, tokenizer_json: str, words: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile the frequent words of ``docs`` and share the file; returns the name under which workers find it. At most
    ``words`` words reach the driver."""
    spark = docs.sparkSession
    codec = Codec(tokenizer_json)
    found = frequent_words(docs, tokenizer_json, words, text_col)
    listed = sorted(bytes(r.word) for r in found.select("word").collect())
    common.release(found)
    path = common.scratch_path(spark, "lexicon")
    common.write_shared_bytes(spark, path, Transducer.build(list(zip(listed, codec.merge_all(listed)))))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def worker_codec(tokenizer_json: str, lexicon: str | None) -> Codec:
    """One codec for each Python worker, with the lexicon mapped into memory."""
    cache = common.worker_cache("bpe")
    key = (hashlib.sha256(tokenizer_json.encode()).hexdigest(), lexicon)
    if key not in cache:
        cache.clear()
        codec = Codec(tokenizer_json)
        codec.lexicon = Transducer.open(SparkFiles.get(lexicon)) if lexicon else None
        cache[key] = codec
    return cache[key]


def map_column(df: DataFrame, schema: T.StructType, column: str, fn: Callable[[pa.Array], dict]) -> DataFrame:
    """Add the columns that ``fn`` makes of a slice of a column; input columns with an output's name give way."""
    new = {f.name for f in schema.fields}
    kept = [f for f in df.schema.fields if f.name not in new]
    whole = T.StructType([*kept, *schema.fields])
    arrow = {f.name: _arrow(f.dataType) for f in schema.fields}
    names = [f.name for f in kept]
    sent = names if column in names else [*names, column]
    common.bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(sent.index(column))
            cuts = [(lo, hi) for lo, hi, _, _ in common.text_slices(values, SLICE)] if pa.types.is_string(values.type) else [(i, i + 1000) for i in range(0, batch.num_rows, 1000)]
            for lo, hi in cuts:
                part = batch.slice(lo, hi - lo)
                made = fn(part.column(sent.index(column)))
                own = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], arrow[f.name]) for f in schema.fields]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), *own], names=[f.name for f in whole.fields])

    return df.select(*(F.col(f"`{c}`") for c in sent)).mapInArrow(run, whole)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def encode_documents(docs: DataFrame, tokenizer_json: str, lexicon: str | None = None, text_col: str = "text", then: Callable[[Encoded, pa.Array], dict] | None = None, then_schema: T.StructType | None = None) -> DataFrame:
    """Add ``ids array<int>`` to every row. ``then(encoded, texts)`` may derive columns of ``then_schema`` from the ids in the
    same pass; those columns then take the place of ``ids``."""
    schema = then_schema or T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def fn(texts: pa.Array) -> dict:
        codec = worker_codec(tokenizer_json, lexicon)
        with common.no_cycles():
            found = codec.encode_column(texts)
            return then(found, texts) if then else {"ids": found.ids()}

    return map_column(docs, schema, text_col, fn)


def decode_documents(df: DataFrame, tokenizer_json: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded string``: the text of every row's ids (null ids: an empty text)."""

    def fn(rows: pa.Array) -> dict:
        codec = worker_codec(tokenizer_json, None)
        return {"decoded": [codec.decode(ids or ()) for ids in rows.to_pylist()]}

    return map_column(df, T.StructType([T.StructField("decoded", T.StringType())]), ids_col, fn)


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(found: Encoded, _texts: pa.Array) -> dict:
    """Count and digest every row's ids and the text that they decode to."""
    sha = hashlib.sha256
    return {
        "n_tokens": pa.array(found.lengths()), "ids_sha256": [sha(x).hexdigest() for x in found.decimals()],
        "decoded_sha256": [sha(x.encode()).hexdigest() for x in found.decoded()],
    }


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``; digests of both."""
    import public_tokenizers

    spec = read_text(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = build_lexicon(docs, spec)
    return encode_documents(docs, spec, lexicon, then=digests, then_schema=DIGESTS).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
