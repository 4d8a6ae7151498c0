"""One model for all rows: hashed terms, inverse document frequencies and logistic regression as a Spark ML pipeline.

The vectors are sparse: a text costs its distinct terms, whatever the number of buckets.  The driver holds one number for
each bucket (the frequencies and the coefficients) and no row; fits sum their gradients in a tree.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.text import TOKEN_PATTERN

BUCKETS = 1 << 18
REGULARIZATION = 0.01
LEAST_DOCUMENTS = 1
DEPTH = 3   # levels in which partial gradients are summed


def stages(text: str, label: str, buckets: int = BUCKETS, regularization: float = REGULARIZATION, least_documents: int = LEAST_DOCUMENTS) -> Pipeline:
    """Terms (letters, digits and underscores, two or more, lower-cased), counts by hash bucket, counts times idf, two classes."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="terms", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        HashingTF(inputCol="terms", outputCol="counts", numFeatures=buckets),
        IDF(inputCol="counts", outputCol="features", minDocFreq=least_documents),
        LogisticRegression(featuresCol="features", labelCol=label, regParam=regularization, standardization=False,
                           tol=1e-10, maxIter=300, aggregationDepth=DEPTH),
    ])


def fit_pooled(train: DataFrame, text: str, label: str, **options) -> PipelineModel:
    """The pipeline fitted on ``train`` (text, label 0/1); a null text counts as empty.

    The objective is the mean log loss plus half the regularisation times the squared weights, intercept left out.
    """
    return stages(text, label, **options).fit(_prepared(train, text, label))


def _prepared(rows: DataFrame, text: str, label: str | None = None) -> DataFrame:
    out = rows.withColumn(text, F.coalesce(text, F.lit("")))
    return out.withColumn(label, F.col(label).cast("double")) if label else out


def predict_pooled(model: PipelineModel, test: DataFrame, text: str) -> DataFrame:
    """``test`` with the chance of class 1 and the predicted class."""
    scored = model.transform(_prepared(test, text))
    chance = F.element_at(vector_to_array("probability"), 2)
    return scored.select(*test.columns, chance.alias("chance"), F.col("prediction").cast("int").alias("predicted_direction"))


def bucket_weights(model: PipelineModel) -> DataFrame:
    """(bucket, documents, idf, weight) of the buckets that occur in the training texts, from the numbers that the driver holds."""
    spark, idf, fitted = SparkSession.active(), model.stages[2], model.stages[3]
    weights, factors = fitted.coefficients.toArray(), idf.idf.toArray()
    rows = [(bucket, int(n), float(factors[bucket]), float(weights[bucket])) for bucket, n in enumerate(idf.docFreq) if n]
    return spark.createDataFrame(rows, "bucket int, documents long, idf double, weight double")


def cells(model: PipelineModel, rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, bucket, n, value): the entries of the sparse vectors of ``rows``, counts and counts times idf."""
    vectors = PipelineModel(model.stages[:3]).transform(_prepared(rows, text))
    count, value = F.unwrap_udt("counts"), F.unwrap_udt("features")
    entries = F.arrays_zip(count["indices"].alias("bucket"), count["values"].alias("n"), value["values"].alias("value"))
    return vectors.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.bucket", "e.n", "e.value")


def margins(entries: DataFrame, weights: DataFrame, keys: list[str], intercept: float) -> DataFrame:
    """(keys, margin) of sparse entries (keys, bucket, value) under a table of weights (bucket, weight); class 1 above 0."""
    found = entries.join(weights.select("bucket", "weight"), "bucket", "left")
    return found.groupBy(*keys).agg((F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))) + F.lit(intercept)).alias("margin"))
