"""The corpus pipeline: language ID, near-duplicates, repeated passages, source mix, token ids.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that calls one operator; its result is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm import bpe, common, langid, mixing, simhash, substring_dedup

#: What a document's place among its source's depends on, before and after the mix is written.
MIX_KEY = ("doc_id", "source", "text_hash")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject null texts, texts without a letter, and texts that no learned language fits: those whose score or lead is
    below what cross-validation of the labelled rows finds. Where no row has a lang, nothing can be learned and only the
    first two go. Null ids and sources, very long texts, ties and repeated rows are judged row by row, by the text alone;
    an empty table stays empty; further columns, whatever their names, are kept as they are."""
    packed, labels = langid.examples(docs.filter(~langid.held_out()))
    if not labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    score, lead = langid.least_fit(packed, labels)
    judged = langid.predict(docs.select(common.packed_row(docs), "text"), langid.fit(packed, labels))
    fits = (F.col("lang_pred") != "und") & (F.col("score") >= score) & (F.col("lead") >= lead)
    return judged.filter(fits).select(*common.row_columns(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of every group that is similar by 0.8 or more in shingles of five words; of
    equal ids the one whose text has the least hash, of repeated rows one. A null id counts as the greatest. Null, empty
    and blank texts have no shingles and form one group; texts of fewer than five words are one shingle; very long texts
    are compared whole; an empty table stays empty; further columns are kept as they are."""
    return simhash.keep_one(docs, words=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words covered by 35-word windows that start anywhere else too; n_chars follows the text. All rows stay: a
    null or empty text loses nothing, nor does one shorter than a window; equal texts, repeated rows and a text's own
    repeats count as any other; null ids are told apart by their texts; very long texts are taken whole; an empty table
    stays empty; further columns are kept as they are."""
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select(common.packed_row(docs, names), "doc_id", "text", "n_chars")
    kept = substring_dedup.remove_repeats(packed, window=35)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    kept = kept.select(*common.row_columns(names), "text", length.alias("n_chars"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix: sources weigh the square root of their size. A null source is a
    source of its own; null ids and repeated rows have places like others, ties are settled by a hash of the row; texts
    play no part; an empty table stays empty; further columns are kept as they are."""
    packed = docs.select(common.packed_row(docs), "doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return mixing.mix(packed, key_cols=MIX_KEY).orderBy("place").select(*common.row_columns(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, place in the mix, n_tokens, ids, and whether the ids decode to the text. Reading files again doesn't keep
    the order in which they were written, so the place, which depends on the rows alone, is found again here. Every row
    gets its ids: a null or empty text has none; null ids, ties and repeated rows are rows like others; very long texts
    are encoded whole; an empty table gives an empty table; further columns are left out."""
    import public_tokenizers

    spec = bpe.read_text(public_tokenizers.path("byte_bpe_50k.json"))
    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def pack(found: bpe.Encoded, texts: pa.Array) -> dict:
        same = [a == (b or "") for a, b in zip(found.decoded(), texts.to_pylist())]
        return {"n_tokens": pa.array(found.lengths()), "ids": found.ids(), "round_trip": same}

    lexicon = bpe.build_lexicon(docs, spec)
    placed = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), "text")
    placed = mixing.mix(placed, key_cols=MIX_KEY).select("doc_id", "place", "text")
    return bpe.encode_documents(placed, spec, lexicon, then=pack, then_schema=schema).select("doc_id", "place", *schema.names)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("token_ids", encode),
]
#: Ridge fits, SimHash of whole texts and BPE aren't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result but the last written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, name)
            common.free_shuffles(spark)
    return docs
