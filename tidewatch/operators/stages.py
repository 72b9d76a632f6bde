"""Detectors as stages of ``pyspark.ml``: estimators and models for pipelines and cross validation, with save and load."""

from __future__ import annotations

import json
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from . import evaluate as V
from .contract import DETECTORS, Detector


class _DetectorParams(Params):
    kind = Param(Params._dummy(), "kind", "the kind of detector, as registered", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "the detector's options, as JSON", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "the columns that it reads", TypeConverters.toListString)
    contamination = Param(Params._dummy(), "contamination", "share of the training rows above the threshold", TypeConverters.toFloat)
    trees = Param(Params._dummy(), "trees", "trees of a forest", TypeConverters.toInt)
    sensitivity = Param(Params._dummy(), "sensitivity", "low, medium or high", TypeConverters.toString)

    def detectorOptions(self) -> dict[str, Any]:  # noqa: N802
        """All options: those of the JSON text, and the parameters that are set."""
        given = {p.name: self.getOrDefault(p) for p in (self.features, self.contamination, self.trees, self.sensitivity) if self.isSet(p)}
        return json.loads(self.getOrDefault(self.options)) | given


class DetectorEstimator(Estimator, _DetectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a detector of any registered kind."""

    @keyword_only
    def __init__(self, *, kind: str = "forest", options: str = "{}", features=None, contamination=None, trees=None, sensitivity=None):
        super().__init__()
        self._setDefault(kind="forest", options="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> DetectorModel:
        detector = DETECTORS[self.getOrDefault(self.kind)](**self.detectorOptions()).fit(dataset)
        return self._copyValues(DetectorModel(detector))


class DetectorModel(Model, _DetectorParams, MLReadable, MLWritable):
    """A fitted detector: ``transform`` adds anomaly_score and predicted_anomaly."""

    def __init__(self, detector: Detector | None = None):
        super().__init__()
        self._setDefault(kind="forest", options="{}")
        self.detector = detector

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.detector.predict(dataset)

    def write(self) -> MLWriter:
        return _DetectorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DetectorReader(cls)


class _DetectorWriter(MLWriter):
    def __init__(self, instance: DetectorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.detector.save(f"{path}/detector")


class _DetectorReader(MLReader):
    def __init__(self, cls: type[DetectorModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> DetectorModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        own = self.cls(Detector.load(spark, f"{path}/detector"))
        own._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(own, metadata)
        return own


class DetectionEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """F1, precision, recall or accuracy of predicted_anomaly against a label; nothing flagged and nothing to flag counts as 0."""

    metric = Param(Params._dummy(), "metric", "f1, precision, recall or accuracy", TypeConverters.toString)
    label = Param(Params._dummy(), "label", "the label column (0/1)", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, metric: str = "f1", label: str = "is_anomaly"):
        super().__init__()
        self._setDefault(metric="f1", label="is_anomaly")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(V.metrics(dataset, self.getOrDefault(self.label)).first()[self.getOrDefault(self.metric)] or 0.0)

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True
