"""Fitted models of any kind on disk, alone or behind the steps that prepare their rows."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tidewatch.models.boosting import BoostingModel, CategoryBoostingModel
from tidewatch.models.classifiers import NearestNeighborsModel
from tidewatch.models.dense import DenseModel
from tidewatch.models.ensembles import StackingEnsemble, StackingModel, VotingModel
from tidewatch.models.extra_trees import ExtraTreesModel
from tidewatch.models.kernel_svm import KernelModel

#: Models of this library that hold no other models, by the name they are saved under.
KINDS = {c.__name__: c for c in (BoostingModel, CategoryBoostingModel, DenseModel, ExtraTreesModel, KernelModel, NearestNeighborsModel)}


def _note(spark: SparkSession, path: str, **what) -> None:
    spark.createDataFrame([(json.dumps(what),)], "note string").write.mode("overwrite").text(f"{path}/note")


def save(spark: SparkSession, model, path: str) -> str:
    """Writes a fitted model, an ensemble with its members; Spark's own models keep their own format."""
    name = type(model).__name__
    if name in KINDS:
        model.save(spark, f"{path}/model")
        _note(spark, path, kind=name)
    elif isinstance(model, (VotingModel, StackingModel)):
        members = list(model.models)
        for i, member in enumerate(members):
            save(spark, model.models[member], f"{path}/member_{i}")
        if isinstance(model, VotingModel):
            _note(spark, path, kind=name, members=members, voting=model.voting, weights=model.weights, classes=model.classes)
        else:
            PipelineModel([model.meta]).write().overwrite().save(f"{path}/meta")
            _note(spark, path, kind=name, members=members, classes=model.settings.classes)
    else:
        PipelineModel([model]).write().overwrite().save(f"{path}/model")
        _note(spark, path, kind="spark")
    return path


def load(spark: SparkSession, path: str):
    note = json.loads(spark.read.text(f"{path}/note").first().value)
    if note["kind"] in KINDS:
        return KINDS[note["kind"]].load(spark, f"{path}/model")
    if note["kind"] == "spark":
        return PipelineModel.load(f"{path}/model").stages[0]
    members = {m: load(spark, f"{path}/member_{i}") for i, m in enumerate(note["members"])}
    if note["kind"] == "VotingModel":
        return VotingModel(members, note["voting"], note["weights"], note["classes"])
    settings = StackingEnsemble(dict.fromkeys(members), "", classes=note["classes"])
    return StackingModel(settings, members, PipelineModel.load(f"{path}/meta").stages[0])


class Scorer:
    """Preparation steps and a model of any kind: scores rows as they come."""

    def __init__(self, steps: PipelineModel, model):
        self.steps, self.model = steps, model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.steps.transform(df))

    def save(self, spark: SparkSession, path: str) -> str:
        self.steps.write().overwrite().save(f"{path}/steps")
        save(spark, self.model, f"{path}/scorer")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scorer":
        return cls(PipelineModel.load(f"{path}/steps"), load(spark, f"{path}/scorer"))
