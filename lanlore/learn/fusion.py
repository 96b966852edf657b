"""MOD13: one embedding per view, joined and classified."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summary import with_class_weight
from .classify import Classifier, _clean_indexer, class_list

EMPTY = "_no_features"


def view_stages(views: Mapping[str, Sequence[str]], width: int) -> list:
    """Assemble, scale and embed each view; a view without columns is one zero."""
    stages, outputs = [], []
    for view, columns in views.items():
        inputs = list(columns) or [EMPTY]
        stages += [
            VectorAssembler(inputCols=inputs, outputCol=f"_{view}_raw", handleInvalid="keep"),
            StandardScaler(inputCol=f"_{view}_raw", outputCol=f"_{view}_scaled", withMean=True, withStd=True),
        ]
        if len(inputs) > width:
            stages.append(PCA(k=width, inputCol=f"_{view}_scaled", outputCol=f"_{view}_embedded"))
            outputs.append(f"_{view}_embedded")
        else:
            outputs.append(f"_{view}_scaled")
    stages.append(VectorAssembler(inputCols=outputs, outputCol="fused", handleInvalid="keep"))
    return stages


class MultiView(Classifier):
    """Scores like any classifier and gives the fused embedding."""

    def score(self, df: DataFrame, prefix: str = "") -> DataFrame:
        return super().score(df.withColumn(EMPTY, F.lit(0.0)), prefix).drop(EMPTY)

    def embed(self, df: DataFrame) -> DataFrame:
        """Adds `embedding`: the concatenated view embeddings."""
        out = self.model.transform(df.withColumn(EMPTY, F.lit(0.0)))
        return out.select(*df.columns, vector_to_array("fused").alias("embedding"))


def fit_multi_view(
    df: DataFrame,
    views: Mapping[str, Sequence[str]],
    label: str = "label",
    width: int = 64,
    hidden: Sequence[int] = (64,),
    weighted: bool = False,
    iterations: int = 100,
    seed: int = 42,
) -> MultiView:
    """A network over the fused views; with `weighted`, a softmax with balanced class weights
    instead, since Spark's network takes no row weights."""
    classes = class_list(df, label)
    prepared = with_class_weight(df.withColumn(EMPTY, F.lit(0.0)), label)
    indexed = _clean_indexer(label).fit(prepared).transform(prepared)
    if weighted:
        head = LogisticRegression(featuresCol="fused", labelCol="label_index", weightCol="weight", family="multinomial", maxIter=iterations)
    else:
        inputs = sum(min(width, max(1, len(c))) for c in views.values())
        head = MultilayerPerceptronClassifier(
            featuresCol="fused", labelCol="label_index", layers=[inputs, *hidden, len(classes)], maxIter=iterations, seed=seed
        )
    model = Pipeline(stages=[*view_stages(views, width), head]).fit(indexed)
    return MultiView(model, classes)
