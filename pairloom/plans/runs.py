"""Queries of models, scorers with a fallback, ingestion and bounded reads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features as fe, graph as gr, models as mo, pairs as pr, similarity as sim
from ..sources import runs as ru, views as v
from ..streaming import ingest as ig
from .base import query


@query("r26_out_of_fold_models")
def r26(spark, d):
    """Logistic regression and boosted trees on native features, each scored by fits on the other folds."""
    pairs = v.predictions(spark, d)
    rows = fe.eda_native(pairs, v.items(spark, d)).drop("title_1", "title_2").withColumn("fold", F.col("id1") % 2)
    columns = ["name_exact", "name_length_ratio", "numeric_jaccard", "brand_equal", "brand_conflict", "attr_key_jaccard", "attr_value_match_ratio", "score"]
    rows = gr.cut(rows)  # once for both models
    one, two = (mo.out_of_fold(rows, columns, "fold", k).select("id1", "id2", F.col("predict").alias(k)) for k in ("logistic", "trees"))
    return one.join(two, ["id1", "id2"])


@query("d3_x6_r27_scores_in_time", "select id1, id2, id1 % 2 = 0 as late from matches")
def r27(spark, d):
    """A scorer that had its half of the pairs done when the time was up; the lexical fallback scores the others."""
    items = v.items(spark, d)
    pairs = v.matches(spark, d).select("id1", "id2")
    checkpoint = ru.Checkpoint(spark, f"{gr.shared_dir(spark)}/pairloom-run-{uuid.uuid4().hex}", {"scorer": "heuristic"}, ["id1", "id2"])
    squash = lambda df, c: df.select("id1", "id2", F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)).alias("predict"))
    heuristic = lambda p: squash(pr.score_pairs(p, items), "predict")
    lexical = lambda p: squash(sim.lexical_fallback(p, items), "score")
    checkpoint.append(ru.score(pairs.filter("id1 % 2 = 1"), heuristic))
    return ru.score_in_time(pairs, heuristic, lexical, checkpoint, seconds=0.0).select("id1", "id2", "late")


@query("x5_accepted_rows", "select event_id, user_id, event_type from (select *, row_number() over (partition by event_type order by event_id) as r from (select *, row_number() over (partition by user_id, event_type order by event_id) as k from events) where k = 1) where r <= 5")
def x5(spark, d):
    """The first event of each user and type, and of those five a type."""
    events = v.read(spark, d, "events", "event_id", "user_id", "event_type").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return ig.accepted(events, "key", "event_type", 5, ["event_id"]).select("event_id", "user_id", "event_type")


@query("x2_lowest_hashes", "select event_type, user_id, cast(turn as int) as turn from (select *, row_number() over (partition by event_type order by md5(user_id::varchar), user_id) as turn from (select distinct event_type, user_id from events)) where turn <= 4")
def x2(spark, d):
    return ig.lowest_hashes(v.read(spark, d, "events", "event_type", "user_id"), "event_type", "user_id", 4)


@query("s3_bounded_prefix", "select * from (select n_nationkey as key, n_name as name from nation order by n_nationkey) union all select * from (select r_regionkey, r_name from region order by r_regionkey limit 2)")
def s3(spark, d):
    """The first 27 rows of two sources in their order."""
    nation = v.read(spark, d, "nation", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    region = v.read(spark, d, "region", F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    paths = [f"{gr.shared_dir(spark)}/pairloom-s3-{uuid.uuid4().hex}" for _ in range(2)]
    for path, df in zip(paths, (nation, region)):
        df.write.parquet(path)
    return ru.read_prefix(spark, paths, ["key", "name"], ["key"], 27)


@query("s4_footer_counts", "select 'part' as name, (select count(*) from part) as n_rows union all select 'orders', (select count(*) from orders)")
def s4(spark, d):
    return spark.createDataFrame([(t, ru.count_rows(spark, f"{d}/{t}.parquet")) for t in ("part", "orders")], "name string, n_rows long")
