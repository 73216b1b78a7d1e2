"""Embeddings by a fitted model of word weights, which is stored and loaded again.

The stages are Spark's own: words, their hashed counts, weights by how rare a
place is in the corpus, and unit length. Fitting counts in how many texts each
place occurs; nothing else of the corpus is kept.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 1024


def fit(texts: DataFrame, text: str = "text", dimension: int = DIMENSION) -> PipelineModel:
    """Learn word weights from all ``texts``; null ones count as empty."""
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_vector", p=2.0),
    ]
    return Pipeline(stages=stages).fit(texts.select(F.coalesce(F.col(text), F.lit("")).alias("_text")))


def save(model: PipelineModel, path: str) -> None:
    """Store a model; what is at ``path`` already is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def embed(df: DataFrame, model: PipelineModel, text: str = "text", output: str = "embedding") -> DataFrame:
    """Add ``output``, ``array<float>`` of unit length; a text without known words gets the zero vector."""
    rows = model.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    vector = vector_to_array("_vector", "float32")
    return rows.withColumn(output, vector).drop("_text", "_words", "_counts", "_weighted", "_vector")
