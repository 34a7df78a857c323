"""The pair features as an estimator, and the bundle of what a training gives.

A fitted model keeps its counts of terms as Parquet beside its metadata, so a
reloaded one gives the same features, and it can be a stage of a pipeline.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.operators import evaluation, scoring
from goldweave.operators.features import FEATURES, FeatureBuilder
from goldweave.operators.graph import settled

#: The threshold that training reports on.
AUTO = 0.9


def titles_of(pairs: DataFrame) -> DataFrame:
    """(id, title_norm): each record of the pairs once; left and right ids are told apart."""
    sides = [pairs.select(F.concat(F.lit(f"{p}:"), F.col(f"{p}_id").cast("string")).alias("id"), F.col(f"{p}_norm").alias("title_norm")) for p in ("l", "r")]
    return sides[0].union(sides[1]).dropDuplicates(["id"])


class TitleFeatures(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Counts the terms of titles: of records (id, title_norm), or of both sides of pairs (columns of ``blocking.with_sides``)."""

    def _fit(self, dataset: DataFrame) -> TitleFeaturesModel:
        records = dataset if "title_norm" in dataset.columns else titles_of(dataset)
        return TitleFeaturesModel(FeatureBuilder.fit(settled(records.select("id", "title_norm"))))


class TitleFeaturesModel(Model, MLReadable, MLWritable):
    """Adds the thirteen features to pairs."""

    def __init__(self, builder: FeatureBuilder | None = None) -> None:
        super().__init__()
        self.builder = builder

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.builder.transform(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: TitleFeaturesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.builder.counts.write.parquet(f"{path}/counts")
        self.model.builder.volumes.write.parquet(f"{path}/volumes")


class _Reader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TitleFeaturesModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(FeatureBuilder(*(self.sparkSession.read.parquet(f"{path}/{n}") for n in ("counts", "volumes"))))
        model._resetUid(told["uid"])
        return model


# ---- bundles ---------------------------------------------------------------------


def train(labeled: DataFrame, valid: DataFrame, path: str, *, records: DataFrame | None = None, gbt_rounds: int = 180, mlp_rounds: int = 1000) -> dict[str, float]:
    """Fit the features and both classifiers on ``labeled`` pairs, measure the fused scores on ``valid``, and keep all of it below ``path``.

    Pairs have the columns of ``blocking.with_sides`` and label; the counts are
    those of ``records`` (id, title_norm) where they are given, else of the pairs.
    """
    features = TitleFeatures().fit(labeled if records is None else records)
    own = settled(features.transform(labeled).withColumn("label", F.col("label").cast("double")))
    models = {"features": features, "gbt": scoring.train_gbt(own, rounds=gbt_rounds), "mlp": scoring.train_mlp(own, rounds=mlp_rounds)}
    scored = settled(score(valid, models)[0])
    metrics = {
        "roc_auc": evaluation.roc_auc(scored, "confidence").first()[0], "average_precision": evaluation.average_precision(scored, "confidence").first()[0],
    }
    for name, at in (("at_0_9", AUTO), ("at_0_5", 0.5)):
        found = evaluation.prf(scored, "confidence", at).first()
        metrics |= {f"{m}_{name}": found[m] for m in ("precision", "recall", "f1")}
    scoring.save_models(path, models, metrics)
    return metrics


def score(pairs: DataFrame, models: dict) -> tuple[DataFrame, bool]:
    """``pairs`` with features, both probabilities and the fused confidence, and whether the features were fitted anew.

    That happens only where the bundle has no usable features: none at all, or
    tables that can't be read.
    """
    features, refitted = models.get("features"), False
    if features is not None:
        try:
            features.builder.volumes.first()
            features.builder.counts.select("kind", "term", "df").first()
        except Exception:
            features = None
    if features is None:
        features, refitted = TitleFeatures().fit(pairs), True
    out = features.transform(pairs)
    for name in ("gbt", "mlp"):
        model = models.get(name)
        out = scoring.probability(model, out, f"{name}_score") if model is not None else out.withColumn(f"{name}_score", F.lit(None).cast("double"))
    return scoring.fused_scores(out), refitted


def load(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(models, metrics) of a bundle; what it lacks is None."""
    models = {"features": None, "gbt": None, "mlp": None}
    try:
        row = spark.read.json(f"{path}/metrics").first()
    except AnalysisException:
        return models, {}
    kinds = {"features": TitleFeaturesModel}
    for name in json.loads(row["models"]):
        try:
            models[name] = kinds.get(name, PipelineModel).load(f"{path}/{name}")
        except Exception:
            if name != "features":  # classifiers can't be replaced; features are fitted anew
                raise
    return models, json.loads(row["metrics"])


__all__ = ["FEATURES", "TitleFeatures", "TitleFeaturesModel", "load", "score", "titles_of", "train"]
