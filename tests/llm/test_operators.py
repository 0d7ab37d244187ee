"""Each operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, repeated rows,
empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import bpe, common, components, embed_dedup, langid, mixing, quality, simhash, substring_dedup, token_files, topk, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    passage = prose(1, 60)
    texts = [
        None, "", "   \n\t ", "one", "Two words", passage, passage, passage.upper(), prose(2, 80) + "\n" + passage, passage + " " + prose(3, 70),
        prose(4, 4000), "a " * 300, "... 123 !!", "naïve Straße école", prose(5, 36), prose(5, 35), prose(5, 34), "x" * 5000, "<|endoftext|> end",
    ]
    rows = [(i, t, None if i % 5 == 0 else ["en", "fr"][i % 2], None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(6, 50), "en", "s0", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# words and hashes


def test_word_bounds_match_the_pattern():
    texts = ["", " a  b\t", "c", "\n", "déjà vu ", "x\x0by"]
    import pyarrow as pa

    column = pa.array([*texts, None])
    seen = []
    for lo, hi, raw, offsets in common.text_slices(column, limit=6):
        starts, ends, first = common.word_bounds(raw, offsets)
        for r in range(hi - lo):
            seen.append([raw[s:e].tobytes().decode() for s, e in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]])])
    assert seen == [WORD.findall(t or "") for t in [*texts, None]]


def test_rolling_hash_is_the_same_anywhere():
    values = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    rolling = common.Rolling(3)
    prefix = rolling.prefix(values)
    a, b = rolling.spans(prefix, np.array([0, 3]), np.array([3, 6]))
    assert a == b


# 1 language


def test_language_id(spark, odd_docs, no_docs):
    train = spark.createDataFrame([(i, prose(i, 30) if i % 2 else prose(i, 30).replace("w", "é"), "en" if i % 2 else "fr") for i in range(60)], "doc_id long, text string, lang string")
    model = langid.train(train)
    got = langid.predict(train, model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    odd = langid.predict(odd_docs.withColumn("score", F.lit("clash")), model)
    rows = {r.doc_id: r for r in odd.collect()}
    assert odd.count() == odd_docs.count()
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 12))
    assert rows[3].lang_pred in ("en", "fr")
    assert langid.predict(no_docs, model).count() == 0
    assert langid.train(no_docs)[0] == []
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.train(no_docs)).collect()} == {"und"}


def test_held_out_languages_are_never_learned(spark, sf_dir):
    got = langid.op1(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9


# 2 search


def brute_top(rows, k):
    out = set()
    for q, wq in rows.items():
        if q % 2:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(wq, w)), i) for i, w in rows.items() if i != q))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_top_k_with_ties_and_odd_vectors(spark, monkeypatch, dense):
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = random.Random(1)
    rows = {i: [rng.choice([0, 0, 1, -2]) for _ in range(6)] for i in range(40)}
    table = spark.createDataFrame([*rows.items(), (41, None), (None, [1] * 6)], "vec_id long, w array<long>")
    got = topk.top_k(table, F.col("vec_id") % 2 == 0, F.col("w"), 5)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows, 5)


def test_top_k_few_and_none(spark):
    table = spark.createDataFrame([(0, [1, 1]), (0, [1, 1]), (2, [1]), (3, [5, -1, 7])], "vec_id long, w array<long>")
    got = topk.top_k(table, F.col("vec_id") == 0, F.col("w"), 9)
    assert [tuple(r) for r in got.orderBy("rank").select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 3, 4), (0, 2, 2, 1)]
    assert topk.top_k(table.limit(0), F.col("vec_id") == 0, F.col("w"), 9).count() == 0


# 3 substrings


def brute_removal(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [5, 35])
def test_substring_removal(odd_docs, window):
    rows = odd_docs.collect()
    want = collections.Counter((r.doc_id, *b) for r, b in zip(rows, brute_removal([r.text for r in rows], window)))
    got = substring_dedup.remove_repeats(odd_docs.withColumn("n_words", F.lit("clash")), window, digest=True)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want


def test_substring_texts_and_columns(odd_docs, no_docs):
    got = substring_dedup.remove_repeats(odd_docs, 35)
    assert set(odd_docs.columns) < set(got.columns)
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert rows[0].text is None and rows[3].text == "one" and rows[2].text == "   \n\t " and rows[5].text == ""
    assert rows[15].n_removed == 35 and rows[16].n_removed == 0
    assert substring_dedup.remove_repeats(no_docs, 35).count() == 0


def test_substring_random_repeats(spark):
    rng = random.Random(3)
    pool = [prose(i, 40, 30) for i in range(6)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng.random(), 25, 30) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 12, digest=True).collect()}
    assert got == dict(enumerate(brute_removal(texts, 12)))


@pytest.mark.parametrize("window", [3, 35, 80, 120])
@pytest.mark.parametrize("bits", [58, 4])
def test_substring_windows_and_colliding_hashes(spark, window, bits):
    """Any window; with 4 bits of hash nearly all arcs collide, which the words at their coordinates must settle."""
    rng = random.Random(window)
    pool = [prose(i, 150, 60) for i in range(5)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng.random(), 70, 60) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    texts += ["a b c " * 120, "x " + "a b c " * 90, pool[0] + " " + pool[1], pool[0][200:] + " end", texts[0], None]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    want = collections.Counter((i, *b) for (i, _), b in zip([*enumerate(texts), (0, "")], brute_removal([*texts, texts[0]], window)))
    got = substring_dedup.remove_repeats(docs, window, digest=True, hash_bits=bits).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_substring_paths_are_compacted(spark):
    """A passage of 400 words in three documents is one path of 366 edges; a fork cuts it in two."""
    passage = prose(1, 400, 10**6).split()
    texts = [" ".join([f"head{i}", *passage, f"tail{i}"]) for i in range(3)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, text_hash long")
    got = substring_dedup.repeated_paths(docs, 35, 58).collect()
    assert sorted((r.doc_id, r.at, r.n) for r in got) == [(i, 1, 366) for i in range(3)]
    more = docs.union(spark.createDataFrame([(3, " ".join([*passage[:200], *prose(2, 60, 10**6).split()]), 3)], docs.schema))
    got = substring_dedup.repeated_paths(more, 35, 58).collect()
    assert sorted((r.doc_id, r.at, r.n) for r in got) == [(0, 1, 166), (0, 167, 200), (1, 1, 166), (1, 167, 200), (2, 1, 166), (2, 167, 200), (3, 0, 166)]


def test_substring_clashing_columns(odd_docs):
    docs = odd_docs.select("*", *(F.lit(7).alias(c) for c in ("__id", "__text", "__hash", "row", "text_hash", "at", "root", "list", "kept", "seen", "n_removed", "a.b")))
    got = substring_dedup.remove_repeats(docs, 35)
    assert {*docs.columns, "n_words"} == set(got.columns) and got.count() == odd_docs.count()
    assert all(r["__id"] == r["row"] == r["a.b"] == 7 for r in got.collect())


# 4 mixing


def test_shares_and_schedule_stay_within_a_block():
    for weights in ({"a": 1.0}, {"a": 3, "b": 2, "c": 1.5, "d": 0.01}, {str(i): i + 1.0 for i in range(40)}):
        given = mixing.shares(weights, 1024)
        assert sum(given.values()) == 1024 and min(given.values()) >= 1
        plan = mixing.schedule(given)
        order = sorted((t, s) for s, ts in plan.items() for t in ts)
        done = collections.Counter()
        for t, s in order:
            done[s] += 1
            assert all(abs(done[x] - n * (t + 1) / 1024) < 1 for x, n in given.items())


def test_mix_places_every_row_once(spark, odd_docs, no_docs):
    rows = [(i, "hot" if i % 3 else f"s{i % 11}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs.withColumn("slot", F.lit(1)), block_rows=4).collect()
    assert len({r.place for r in got}) == 3000 and {r.doc_id for r in got} == set(range(3000))
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(len(slots)))
    odd = mixing.mix(odd_docs, weights={"s1": 0.5, "s2": 0.0}, block_rows=1)
    assert odd.count() == odd_docs.count() and odd.select("place").distinct().count() == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0


# 5 quality


def test_quality_separates_and_handles_odd_rows(spark, odd_docs, no_docs):
    rows = [(i, prose(i, 60, 5000) if i % 2 else "$$ %% BUY!! " * 20, i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels, learn).collect()}
    assert all((got[i] > 0.5) == bool(q) for i, _, q in rows)
    odd = quality.score_documents(odd_docs, labels, learn).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_documents(no_docs, labels, learn).count() == 0
    none = quality.score_documents(odd_docs, labels.limit(0), learn).collect()
    assert {r.score for r in none} == {0.5}


def test_pooled_violators_are_the_best_rising_steps():
    weight = np.array([1.0, 0, 1, 2, 1])
    level = quality.pool_violators(weight, np.array([0.5, 0, 0.9, 0.8, 1.0]))
    assert np.isnan(level[1]) and np.allclose(level[[0, 2, 3, 4]], [0.5, 1.7 / 3, 1.7 / 3, 1.0])


# 6 embeddings


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((200, 16)), rng.standard_normal((200, 16)) * 1e-6
    ua, qa, sa, ea = embed_dedup.quantise(a)
    ub, qb, sb, eb = embed_dedup.quantise(b)
    off = np.abs(ua @ ub.T - (qa @ qb.T) * sa[:, None] * sb[None, :])
    assert (off <= ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :] + 1e-9).all()


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 8))
    rows = [(i, (base[i % 12] + 0.12 * rng.standard_normal(8)).tolist()) for i in range(150)]
    rows += [(150 + i, rows[3][1]) for i in range(5)] + [(160, [x * 7 for x in rows[3][1]])]
    odd = [(170, None), (171, [0.0] * 8), (172, [1.0, None] + [0.0] * 6), (173, [float("nan")] * 8), (174, []), (175, [float("inf")] * 8), (176, rows[3][1][:4])]
    x = np.array([r[1] for r in rows])
    c = (x @ x.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    near = c >= 0.95
    np.fill_diagonal(near, False)
    root = {r[0]: r[0] for r in rows}
    for _ in range(200):
        for i, j in zip(*np.nonzero(near)):
            root[rows[i][0]] = root[rows[j][0]] = min(root[rows[i][0]], root[rows[j][0]])
    want = {r[0]: (int(near[i].sum()), root[r[0]]) for i, r in enumerate(rows)} | {i: (0, i) for i, _ in odd}
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = embed_dedup.near_duplicates(table, 0.95).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed_dedup.near_duplicates(table.limit(0)).count() == 0


# 7 simhash


def brute_fingerprint(text, words, lower=str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})):
    w = WORD.findall((text or "").translate(lower))
    parts = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, odd_docs, no_docs):
    rng = random.Random(5)
    base = [prose(i, 60) for i in range(8)]
    texts = []
    for i in range(120):
        w = base[i % 8].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [brute_fingerprint(t, 3) for t in texts]
    root = list(range(len(fps)))
    for _ in range(10):
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.fp.hex(), r.component_id) for r in simhash.near_duplicates(docs, 3, 64, 2, 2, 3, None).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in range(len(fps))}
    odd = simhash.near_duplicates(odd_docs, 3, 64, 2, 2, 3, None).collect()
    assert len(odd) == odd_docs.count() and all(int(r.fp.hex(), 16) == 0 and r.component_id == 0 for r in odd if r.doc_id in (0, 1, 2))
    assert simhash.near_duplicates(no_docs, 3, 64, 2, 2, 3, None).count() == 0


def test_allotted_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 10_000, (50, 4)).astype(float)
    got = simhash.allot(counts, [16] * 4, np.full(4, 2.0), -1, 2)
    assert (got.sum(1) == -1).all() and got.min() >= -1
    # the costliest bucket of a row is the one not probed
    assert (got[np.arange(50), counts.argmax(1)] <= 0).all()


def test_large_buckets_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_BLOCK", 16)
    rng = random.Random(9)
    values = {0} | {1 << rng.randrange(64) | 1 << rng.randrange(64) for _ in range(150)}
    fps = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fp binary")
    links = simhash.similar_fingerprints(fps, 64, 2, 2, 3)
    roots = components.connected_components(links.select(F.hex("a").alias("a"), F.hex("b").alias("b")))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(values)


def test_keep_one_of_each_group(odd_docs):
    kept = simhash.keep_one(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and 5 in ids and 6 not in ids and 7 not in ids and ids.count(5) == 1
    assert {3, 4, 8, 9, 10, 13, None} <= set(ids)


@pytest.mark.parametrize("alone", [0, 200_000])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_of_paths_and_stars(spark, monkeypatch, alone, kind):
    from pairloom.operators import graph

    monkeypatch.setattr(graph, "ONE_TASK_EDGES", alone)
    edges = [(i, i + 1) for i in range(0, 70)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    links = spark.createDataFrame(edges, "a long, b long").select(*(F.col(c) if kind == "long" else F.encode(F.lpad(F.col(c).cast("string"), 4, "0"), "utf-8").alias(c) for c in "ab"))
    sets = collections.defaultdict(set)
    for r in components.connected_components(links).collect():
        sets[r.root].add(r.node)
    assert sorted(map(len, sets.values())) == [1, 50, 71] and all(k == min(v) for k, v in sets.items())


# 8 token files


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_segments_round_trip(n):
    rng = np.random.default_rng(n)
    for high in (1, 5, 50_000, 2**32 - 1):
        ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(0, high, n)).astype(np.uint32)
        data = token_files.pack(ids, np.array([n]))
        lengths, back = token_files.unpack(data)
        assert lengths.tolist() == [n] and back.tolist() == ids.tolist()
        assert token_files.unpack(data, slice(1, 2))[1].tolist() == ids[256:512].tolist()


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_files.write_tokens(odd_docs, str(tmp_path / "t"), path, 2)
    got = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        want = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (r.doc_id, start, len(want), want)
        start += len(want)
    token_files.write_tokens(no_docs, str(tmp_path / "e"), path, 2)
    assert token_files.read_tokens(spark, str(tmp_path / "e"), digest=True).count() == 0


# 9 URL filters


def test_url_filter_intervals_and_kinds(spark):
    entries = [
        ("block", "domain", "bad.com", "add", 10), ("block", "domain", "bad.com", "remove", 20), ("block", "domain", "bad.com", "add", 30), ("block", "host", "a.ok.org", "add", 0),
        ("block", "prefix", "ok.org/ads/", "add", 5), ("allow", "host", "good.bad.com", "add", 12), ("block", "host", "tie.net", "add", 7), ("block", "host", "tie.net", "remove", 7), ("block", "host", "tie.net", "add", 7),
    ]
    pages = [
        (1, "http://x.bad.com/p", 9, "pass"), (2, "http://x.bad.com/p", 10, "block"), (3, "HTTPS://u:p@X.BAD.com.:80/p?q#f", 19, "block"), (4, "http://bad.com", 20, "pass"), (5, "bad.com/x", 31, "block"),
        (6, "http://a.ok.org/", 1, "block"), (7, "http://b.a.ok.org/", 1, "pass"), (8, "http://ok.org/ads/1", 6, "block"), (9, "http://ok.org/adsx", 6, "pass"), (10, "http://good.bad.com/", 15, "allow"),
        (11, "http://tie.net/", 8, "pass"), (12, None, 8, "pass"), (13, "", 8, "pass"), (14, "http://bad.com/", None, "pass"), (15, "http://notbad.com/", 15, "pass"),
    ]
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, since int")
    c = spark.createDataFrame([(i, u, t, "x") for i, u, t, _ in pages], "page_id long, url string, fetched_at int, host string")
    got = url_filter.evaluate(c, e)
    assert {r.page_id: r.decision for r in got.collect()} == {i: d for i, _, _, d in pages}
    assert {r.decision for r in url_filter.evaluate(c, e.limit(0)).collect()} == {"pass"}
    assert url_filter.evaluate(c.limit(0), e).count() == 0


# 10 BPE


@pytest.fixture(scope="module")
def spec():
    return bpe.read_text(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spec):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.Codec(spec)
    rng = random.Random(4)
    letters = " \n\t  \x1c'stre" + "aé1²٣中!?.<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["", " ", "a" * 900, "  " * 99 + "x", "ab" * 700, "x<|endoftext|>y <|endoftext|>", "don't we'll I'm"]
    for text, ids in zip(texts, codec.encode_all(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_lexicon_changes_nothing(spark, odd_docs, no_docs, spec):
    codec = bpe.Codec(spec)
    lexicon = bpe.build_lexicon(odd_docs, spec, words=50)
    got = bpe.encode_documents(odd_docs.withColumn("ids", F.lit("clash")), spec, lexicon)
    assert all(r.ids == codec.encode(r.text) for r in got.collect()) and got.count() == odd_docs.count()
    back = bpe.decode_documents(got, spec).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode_documents(no_docs, spec, bpe.build_lexicon(no_docs, spec)).count() == 0


def test_transducer_shares_suffixes(spec):
    codec = bpe.Codec(spec)
    words = sorted({f"{a}{b}ing".encode() for a in "abcdefgh" for b in "rstuv"})
    data = bpe.Transducer.build(list(zip(words, codec.merge_all(words))))
    t = bpe.Transducer(data)
    assert t.find(words) == codec.merge_all(words) and t.find([b"", b"arin", b"zz", b"aringx"]) == [None] * 4
    assert len(t.finals) == 6  # root, after the first letter, after the second, and three more for the ending


def test_sketch_keeps_frequent_words():
    counts = collections.Counter({f"w{i}": 1 for i in range(1000)} | {"hot": 500, "warm": 90})
    kept = bpe._prune(counts, 10)
    assert kept["hot"] == 499 and set(kept) == {"hot", "warm"}


# whole jobs of the near-duplicate stage


def brute_components(texts, words, similarity):
    sets = []
    for t in texts:
        w = WORD.findall(t.lower())
        sets.append({" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or {" ".join(w)})
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if root[i] != root[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


@pytest.mark.parametrize("block", [512, 16])
def test_all_candidates_are_verified(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "CLUSTER_BLOCK", block, raising=False)
    rng = random.Random(11)
    base = prose(12, 400, 5000).split()
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(4, 13)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    want = brute_components(texts, 5, 0.8)
    assert len(set(want)) > 3
    assert got == dict(enumerate(want))


def test_equal_fingerprints_are_verified(spark):
    line = "this same line comes again "
    texts = [line * 200 + prose(20 + i, 180, 10**6) for i in range(6)]
    texts += [texts[0].upper(), texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len({r.fp for r in got}) == 1
    assert {r.doc_id: r.component_id for r in got} == {**{i: i for i in range(6)}, 6: 0, 7: 0}


# whole jobs of the mix


def test_fluid_stays_within_a_block_of_the_weights():
    third = {"hot": 10.0, **{f"s{i}": 20.0 / 19 for i in range(19)}}
    zipf = {f"z{i:03}": 1.0 / (i + 1) for i in range(400)}
    for weights, n in ((third, 60_000), (zipf, 20_000)):
        total = sum(weights.values())
        blocks = {s: n for s in weights}
        done = collections.Counter()
        for t, (s, i, k) in zip(range(n), mixing.fluid(weights, blocks)):
            assert i == done[s] and k == 0
            done[s] += 1
            if t % 997 == 0 or t > n - 50:
                assert all(abs(done[x] - w / total * (t + 1)) < 1 + 1e-9 for x, w in weights.items())


def test_fluid_hands_on_the_share_of_sources_that_run_out():
    weights, blocks = {"a": 0.3, "b": 1.7, "c": 1.0, "d": 5.0}, {"a": 40, "b": 31, "c": 7, "d": 90}
    seen = list(mixing.fluid(weights, blocks))
    assert collections.Counter(s for s, _, _ in seen) == blocks and seen[-1][2] == 3
    order = [i for s, i, _ in seen if s == "a"]
    assert order == list(range(40)) and [s for s, _, _ in seen[-20:]] == ["a"] * 20


def test_mix_serves_every_small_source_by_its_weight(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HELD", 300, raising=False)
    rows = [(i, f"s{i % 400:03}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {f"s{i:03}": 1.0 + (i % 4) for i in range(400)}
    got = sorted(mixing.mix(docs, weights, block_rows=1).collect(), key=lambda r: r.place)
    total = sum(weights.values())
    first = collections.Counter(r.source for r in got[:4000])
    assert len(got) == 8000 and all(abs(first[s] - 4000 * w / total) < 1 + 1e-9 for s, w in weights.items())


# dense and brute-force counterparts


def test_language_fit_is_kernel_ridge():
    """With every row a landmark, scores are those of dense kernel ridge regression on shared n-grams."""
    rng = random.Random(2)
    letters = {"aa": "aeiou", "bb": "bcdfg", "cc": "xyzpq"}
    texts = [(c, "".join(rng.choice(letters[c] + " ") for _ in range(40))) for c in sorted(letters) for _ in range(12)]

    def grams(text):
        text = f" {text.lower()} "
        return {text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)}

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    sets = [grams(t) for _, t in texts]
    bits = langid.presence([t for _, t in texts])
    assert all(0.97 * len(g) <= n <= len(g) for g, n in zip(sets, bits.sum(1)))  # few n-grams share a slot
    slots = lambda ts: [set(np.flatnonzero(x)) for x in langid.presence(ts)]
    sets = slots([t for _, t in texts])
    labels = [c for c, _ in texts]
    classes, matrix = langid.fit(np.packbits(bits, axis=1), labels)
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.where(np.array(labels)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    alpha = np.linalg.solve(k + langid.RIDGE * len(k) / len(k) * np.eye(len(k)), y)
    fresh = ["".join(rng.choice("aeioubcxy ") for _ in range(30)) for _ in range(10)]
    want = np.array([[kernel(a, b) for b in sets] for a in slots(fresh)]) @ alpha
    got = langid.outputs(np.packbits(langid.presence(fresh), axis=1), matrix)
    assert np.allclose(got, want, atol=2e-3)


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 60)
    same = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    near = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("fr").alias("lang"))
    packed, labels = langid.examples(same.union(near))
    assert collections.Counter(labels) == {"en": 1, "fr": 30} and len(packed) == 31


def test_quality_is_ridge_on_all_rows(spark):
    """Sums over partitions give what one dense solution gives, calibration included."""
    rng = np.random.Generator(np.random.PCG64(3))
    stats = rng.uniform(0, 1, (600, quality.STATS))
    y = (stats[:, 0] + 0.3 * rng.standard_normal(600) > 0.5).astype(float)
    fold = np.arange(600) % 2
    learn = spark.createDataFrame([(s.tolist(), float(a), int(f)) for s, a, f in zip(stats, y, fold)], "stats array<double>, y double, fold int").repartition(9)
    got = quality.fit(learn)(stats)
    features = quality.Features(stats.mean(0), np.sqrt(np.maximum((stats**2).mean(0) - stats.mean(0) ** 2, 1e-12)) + 1e-9)
    z = features(stats)

    def ridge(rows):
        a = z[rows]
        return np.linalg.solve(a.T @ a + quality.RIDGE * len(a) / quality.FEATURES * np.eye(z.shape[1]), a.T @ y[rows])

    apart = np.where(fold == 0, z @ ridge(fold == 1), z @ ridge(fold == 0))
    at = np.clip(((apart + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    weight, total = np.bincount(at, minlength=quality.BINS), np.bincount(at, y, quality.BINS)
    level = quality.pool_violators(weight.astype(float), total)
    seen = np.flatnonzero(~np.isnan(level))
    want = np.clip(np.interp(z @ ridge(fold >= 0), (seen + 0.5) / quality.BINS * 2 - 0.5, level[seen]), 0, 1)
    assert np.abs(got - want).mean() < 1e-6


def test_many_partitions_add_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(quality, "FAN_IN", 3)
    rows = spark.range(100).repartition(20).select(F.col("id").cast("double").alias("x"))

    def fn(batches):
        total = np.zeros(2)
        for b in batches:
            total += [b.column(0).to_numpy().sum(), b.num_rows]
        return {0: total}

    assert quality._summed(rows, fn, 2)[0].tolist() == [4950.0, 100.0]


def test_links_of_extreme_vectors(spark):
    base = np.random.Generator(np.random.PCG64(4)).standard_normal(8)
    rows = [(i, (base * s).tolist()) for i, s in enumerate((1e200, 3e200, 1e-200, 2e-200, 1.0, -1.0))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {5: (0, 5)}


def test_packs_meet_by_blocks(spark, monkeypatch):
    """Many small packs, shuffled by pairs of blocks: no pair of vectors is lost or met twice."""
    from pairloom.llm import vectors

    monkeypatch.setattr(embed_dedup, "packs_for", lambda n, size=0: 40)
    monkeypatch.setattr(topk, "packs_for", lambda n, size=0: 35)
    assert vectors.blocks_for(40) == (2, 20)
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.standard_normal((120, 3)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    links = (unit @ unit.T >= 0.95 - 1e-12).sum(1) - 1
    assert {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, 0.95).collect()} == dict(enumerate(links.tolist()))
    whole = {i: np.floor(v * 64).astype(int).tolist() for i, v in enumerate(x)}
    weights = F.transform("embedding", lambda v: F.floor(v * 64))
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 2 == 0, weights, 4).collect()}
    assert got == brute_top(whole, 4)


def test_url_filter_against_every_entry(spark, monkeypatch):
    """A supplied list with thousands of prefixes of one host, and parts of few visits."""
    monkeypatch.setattr(url_filter, "PART_VISITS", 7)
    rng = random.Random(6)
    hosts = ["hot.com", "a.hot.com", "b.org"]
    entries = [(rng.choice(["block", "allow"]), "prefix", f"hot.com/{rng.randrange(3000)}", rng.choice(["add", "add", "remove"]), rng.randrange(20)) for _ in range(3000)]
    entries += [(rng.choice(["block", "allow"]), rng.choice(["host", "domain"]), rng.choice(["hot.com", "com", "b.org"]), rng.choice(["add", "remove"]), rng.randrange(20)) for _ in range(30)]
    captures = [(i, f"http://{rng.choice(hosts)}/{rng.randrange(3000)}/x", rng.randrange(-1, 21), "own") for i in range(300)]

    def active(url, time):
        full = url.removeprefix("http://")
        host = full.split("/")[0]
        last = {}
        for name, kind, pattern, action, since in sorted(entries, key=lambda e: (e[4], e[3])):
            meets = host == pattern if kind == "host" else host == pattern or host.endswith("." + pattern) if kind == "domain" else full.startswith(pattern) and pattern.split("/")[0] == host
            if meets and since <= time:
                last[name, kind, pattern] = action
        return sorted(":".join(k) for k, a in last.items() if a == "add")

    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at int, names string")
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, since int")
    got = {r.page_id: r for r in url_filter.evaluate(c, e).collect()}
    for i, url, time, _ in captures:
        names = active(url, time)
        assert got[i].active == names and got[i].names == "own"
        assert got[i].decision == ("allow" if any(n.startswith("allow:") for n in names) else "block" if names else "pass")


def test_fluid_with_thousands_of_sources():
    weights = {f"s{i}": 1.0 + i % 7 for i in range(5000)}
    total, done = sum(weights.values()), collections.Counter()
    for t, (s, i, _) in zip(range(20_000), mixing.fluid(weights, {s: 1000 for s in weights})):
        done[s] += 1
        if t % 4999 == 0:
            assert all(abs(done[x] - w / total * (t + 1)) < 1 + 1e-9 for x, w in weights.items())


def test_texts_beyond_a_slice(spark):
    """One text longer than what is worked on at a time, between short ones."""
    long = prose(31, 260_000, 10**7)
    assert len(long) > 1 << 20
    texts = ["short one", long, prose(32, 50) + " " + long[:2000], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 35, digest=True).collect()}
    assert got == dict(enumerate(brute_removal(texts, 35)))
    found = {r.doc_id: r.fp for r in simhash.fingerprints(docs.withColumn("text_hash", F.xxhash64("text")), 3, 64).collect()}
    assert all(int.from_bytes(found[i], "big") == brute_fingerprint(t or "", 3) for i, t in enumerate(texts))
    made = {r.doc_id: r.stats for r in quality.document_statistics(docs).collect()}
    raw = np.frombuffer(long.encode(), np.uint8)
    assert np.allclose(made[1], quality.statistics(raw, np.array([0, len(raw)]))[0])
    assert np.isclose(made[1][10], np.log1p(260_000))


def test_token_files_of_a_very_long_text(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["a b", prose(33, 1_500_000, 3000), "end"]
    assert len(texts[1]) > 8 << 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_tokens(docs, str(tmp_path / "t"), path, end=2)
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, str(tmp_path / "t"), digest=True).collect()} == want


def test_token_queries_equal_the_library(spark, sf_dir):
    """The registered queries' digests against the library's ids of every whole text."""
    from tokenizers import Tokenizer

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for i, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op8(spark, sf_dir).collect()} == want
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10(spark, sf_dir).collect()} == want


def test_other_rules_send_texts_whole(spark, tmp_path):
    """A tokenizer file that isn't the word-wise kind gives the library's ids too."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["Upper  and lower", "don't", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_tokens(docs, str(tmp_path / "t"), path, end=2)
    got = {r.doc_id: list(r.ids) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(bpe.read_text(public_tokenizers.path("word_bpe_49k.json")))


def test_lexicon_words_are_the_frequent_ones(spark, spec):
    texts = [" ".join(f"w{i}" for i in range(1, 200) for _ in range(200 // i))]
    docs = spark.createDataFrame([(0, texts[0])], "doc_id long, text string")
    got = [bytes(r.word).decode().strip() for r in bpe.frequent_words(docs, spec, 40).collect()]
    assert 25 <= len(got) <= 40 and "w1" not in got  # pieces of words: letters, digits
    assert {"w"} <= set(got)


def test_keep_one_keeps_own_columns(odd_docs):
    docs = odd_docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("__id", "__own", "__hash", "row", "text_hash", "root", "a.b"))))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert all((r["__id"], r["__own"], r["__hash"], r["row"], r["text_hash"], r["root"], r["a.b"]) == tuple(range(7)) for r in got.collect())


def test_links_across_lone_buckets(spark):
    """Where fingerprints crowd in one partition, others are probed by flips, and those must meet buckets of one row."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 42, 500, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(42, 2, replace=False)) for _ in base]
    every = [int(x) for x in np.unique(np.concatenate([base, base ^ np.array(flips, np.uint64)]))]
    rows = spark.createDataFrame([(bytearray(x.to_bytes(8, "big")),) for x in every], "fp binary")
    root = {x: x for x in every}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in simhash.similar_fingerprints(rows, 64, 2).collect():
        root[top(int.from_bytes(r.a, "big"))] = top(int.from_bytes(r.b, "big"))
    near = [(x, y) for i, x in enumerate(every) for y in every[i + 1 :] if (x ^ y).bit_count() <= 2]
    assert near and [p for p in near if top(p[0]) != top(p[1])] == []


def test_packs_of_queries_are_not_broadcast(spark):
    rows = spark.range(200).select("id", F.array((F.col("id") % 7) - 3, F.col("id") % 300, F.lit(1 << 20)).alias("w"))
    found = topk.top_k(rows, F.col("id") % 20 == 0, F.col("w"), 3, "id")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    for values in ([], [0, -128, 127], [128], [-32769, 5], [1 << 31], [-(1 << 63), (1 << 63) - 1]):
        x = np.array(values, np.int64)
        assert topk._ints(topk._bytes(x)).tolist() == values
