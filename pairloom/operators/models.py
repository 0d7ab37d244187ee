"""Models of pairs with pyspark.ml: logistic regression and boosted trees over feature columns, scored out of fold."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pipeline(columns: list[str], kind: str) -> Pipeline:
    """Columns to one vector, scaled for ``logistic``, and the classifier of that kind (or ``trees``)."""
    made = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="keep")
    if kind == "logistic":
        return Pipeline(stages=[made, StandardScaler(inputCol="__v", outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="__y", regParam=0.01, maxIter=50)])
    if kind == "trees":
        return Pipeline(stages=[made, GBTClassifier(featuresCol="__v", labelCol="__y", maxIter=20, maxDepth=4, seed=1)])
    raise ValueError(f"no model of kind {kind!r}")


def out_of_fold(df: DataFrame, columns: list[str], fold: str, kind: str, target: str = "target") -> DataFrame:
    """``df`` with ``predict``: the probability that a model fitted on the other folds gives (one fit a fold)."""
    rows = df.withColumn("__y", F.col(target).cast("double")).fillna(0.0, columns)
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]  # the folds
    out = None
    for k in folds:
        model = pipeline(columns, kind).fit(rows.filter(F.col(fold) != k))
        part = model.transform(rows.filter(F.col(fold) == k)).withColumn("predict", vector_to_array("probability")[1]).select(*df.columns, "predict")
        out = part if out is None else out.unionByName(part)
    return out
