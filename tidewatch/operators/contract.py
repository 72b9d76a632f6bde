"""Detectors with one contract: fit, predict, evaluate, save and load. State is tables, kept as Parquet beside a JSON note."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import sqltext as S
from ..sources.staging import staged
from . import components as K
from . import detectors as D
from . import ensemble as E
from . import evaluate as V
from . import models as M
from . import order
from . import profiles as P
from . import tuning as U

DETECTORS: dict[str, Callable[..., Detector]] = {}


def register_detector(name: str, factory: Callable[..., Detector]) -> None:
    DETECTORS[name] = factory


class Detector:
    """``predict`` adds predicted_anomaly (0/1) and anomaly_score; the tables that ``fit`` makes are in ``state``."""

    kind = ""

    def __init__(self, **options):
        self.options, self.state = options, {}

    def fit(self, df: DataFrame) -> Detector:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def evaluate(self, df: DataFrame, label: str = "is_anomaly") -> DataFrame:
        scored = df if "predicted_anomaly" in df.columns else self.predict(df)
        return V.metrics(scored, label)

    def save(self, path: str) -> None:
        for name, table in self.state.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        _write_note(SparkSession.active(), path, {"kind": self.kind, "tables": sorted(self.state), "options": self.options})

    def restore(self, spark: SparkSession, path: str, note: dict) -> None:
        self.state = {t: spark.read.parquet(f"{path}/{t}") for t in note["tables"]}

    @staticmethod
    def load(spark: SparkSession, path: str, **options) -> Detector:
        """The detector as it was saved; ``options`` given here replace saved ones."""
        note = _read_note(spark, path)
        if note["kind"] not in DETECTORS:
            raise ValueError(f"no detector of kind {note['kind']!r} is registered")
        own = DETECTORS[note["kind"]](**(note["options"] | options))
        own.restore(spark, path, note)
        return own


def _write_note(spark: SparkSession, path: str, note: dict) -> None:
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")


def _read_note(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/note").first().value)


class DosDetector(Detector):
    """Thresholds from the training frame's quantiles, applied to any frame."""

    kind = "dos"

    def fit(self, df: DataFrame) -> Detector:
        rows = D.dos_features(df, self.options.get("key", "src_ip"), self.options.get("seconds", 30))
        self.state["limits"] = P.quantile_thresholds(rows, D.DOS_FEATURES, self.options.get("percentile", 99.9))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        rows = D.dos_features(df, self.options.get("key", "src_ip"), self.options.get("seconds", 30))
        return D.dos_score(rows, self.state["limits"])


class SequenceDetector(Detector):
    kind = "sequence"

    def _by(self) -> tuple:
        return F.concat_ws("_", *self.options.get("states", ["service", "protocol"])), self.options.get("partition", ["src_ip"]), self.options.get("order", ["timestamp", "row_id"])

    def fit(self, df: DataFrame) -> Detector:
        self.state["transitions"] = D.transitions(df, *self._by(), self.options.get("min_freq", 5))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        raw = D.sequence_scores(df, self.state["transitions"], *self._by(), self.options.get("length", 10))
        return D.sequence_labels(raw)


class ProfileDetector(Detector):
    """Summed excess over the training frame's global profile."""

    kind = "profile"

    def fit(self, df: DataFrame) -> Detector:
        self.state["profile"] = P.profile(df.where("is_anomaly = 0") if "is_anomaly" in df.columns else df, "global", [], self.options["features"])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = P.score_against(df, self.state["profile"], [], self.options["features"], "anomaly_score", P.SENSITIVITY[self.options.get("sensitivity", "medium")])
        return out.withColumn("predicted_anomaly", (F.col("anomaly_score") > 0).cast("int"))


class ForestDetector(Detector):
    """An isolation forest whose threshold comes from the training frame, so scores compare across frames.

    With ``best_f1`` and labels, the threshold is the one of 100 between the training scores' extremes that has the best F1. With ``tune``, trees,
    share of features and contamination are those of ``tuning.forest_grid`` with the best F1 (``auto``: scores over .5). ``scale``: features are
    standardised by the training frame. ``components``: the forest works on the principal components that explain this share of the
    training frame's variance; the projection is a table of the detector's state, fitted once and applied to every frame.
    """

    kind = "forest"

    def _features(self) -> list[str]:
        return K.names(self.state["projection"]) if "projection" in self.state else self.options["features"]

    def _rows(self, df: DataFrame) -> DataFrame:
        if "projection" in self.state:
            return K.project(df, self.state["projection"])
        if "scale" not in self.state:
            return df
        stats, features = self.state["scale"], self.options["features"]
        scale = lambda c: F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}"), F.lit(0.0))
        return df.crossJoin(F.broadcast(stats)).withColumns({c: scale(c) for c in features}).drop(*stats.columns)

    def fit(self, df: DataFrame) -> Detector:
        features, labelled = self.options["features"], "is_anomaly" in df.columns
        if self.options.get("components"):
            self.state["projection"] = K.fit_projection(df, features, self.options["components"])
        elif self.options.get("scale"):
            deviation = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
            self.state["scale"] = staged(df.agg(*[x for c in features for x in (F.avg(c).alias(f"__m_{c}"), deviation(c).alias(f"__s_{c}"))]), "scale")
        rows, features = self._rows(df), self._features()
        if self.options.get("tune") and labelled:
            best = U.forest_grid(rows, features, **self.options.get("grid", {})).first()
            self.options |= {"trees": best.trees, "feature_share": best.feature_share, "contamination": best.contamination if best.contamination == "auto" else float(best.contamination)}
        nodes = staged(M.fit_isolation_forest(rows, features, self.options.get("trees", 100), seed=self.options.get("seed", 42), feature_share=self.options.get("feature_share", 1.0)), "nodes")
        scored = staged(M.score_isolation_forest(rows, nodes, features), "scores")
        if self.options.get("best_f1") and labelled:
            limit = U.best_threshold(scored, "anomaly_score")
        elif self.options.get("contamination") == "auto":
            limit = 0.5
        else:
            limit = order.quantile(scored, "anomaly_score", 1 - self.options.get("contamination", 0.05))
        self.state |= {"nodes": nodes, "limit": df.sparkSession.createDataFrame([(limit,)], "threshold double")}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        rows = self._rows(df)
        scored = M.score_isolation_forest(rows, self.state["nodes"], self._features()).drop(*(self._features() if "projection" in self.state else ()))
        return scored.crossJoin(F.broadcast(self.state["limit"])).withColumn("predicted_anomaly", F.coalesce((F.col("anomaly_score") >= F.col("threshold")).cast("int"), F.lit(0))).drop("threshold")


class FactorDetector(Detector):
    """The local outlier factor against all training rows, with the threshold that leaves ``contamination`` of them above it."""

    kind = "factor"

    def _vectors(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__v", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.options["features"]]))

    def fit(self, df: DataFrame) -> Detector:
        key, k = self.options.get("key", "row_id"), self.options.get("neighbours", 20)
        model = M.fit_local_outlier_factor(self._vectors(df), "__v", key, k)
        own = staged(M.score_local_outlier_factor(model.select("key", "v"), model, "v", "key", k), "factor_scores")
        limit = order.quantile(own, "anomaly_score", 1 - self.options.get("contamination", 0.05))
        self.state = {"model": model, "limit": df.sparkSession.createDataFrame([(limit,)], "threshold double")}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        scored = M.score_local_outlier_factor(self._vectors(df), self.state["model"], "__v", self.options.get("key", "row_id"), self.options.get("neighbours", 20)).drop("__v")
        return scored.crossJoin(F.broadcast(self.state["limit"])).withColumn("predicted_anomaly", F.coalesce((F.col("anomaly_score") > F.col("threshold")).cast("int"), F.lit(0))).drop("threshold")


class TextDetector(Detector):
    """The SQL text detector (row_id, ts, ip, query) with its models; without models where there were too few texts to learn from."""

    kind = "text"

    def __init__(self, **options):
        super().__init__(**options)
        self.models: M.TextModels | None = None

    def fit(self, df: DataFrame) -> Detector:
        self.models = M.TextModels.fit(df, "query", self.options.get("trees", 100)) if self.options.get("use_models", True) else None
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return S.detect(self.models.score(df) if self.models else df, self.options.get("base", 0.5), tokens=self.options.get("tokens", False))

    def save(self, path: str) -> None:
        if self.models:
            self.models.save(f"{path}/models")
        _write_note(SparkSession.active(), path, {"kind": self.kind, "tables": [], "options": self.options, "models": self.models is not None})

    def restore(self, spark: SparkSession, path: str, note: dict) -> None:
        self.models = M.TextModels.load(spark, f"{path}/models") if note["models"] else None


class EnsembleDetector(Detector):
    """Detectors by name (made by ``members``: name to kind and options), fused by a strategy; weights are 1 unless given or learned (``learn_weights``: F1 on the training frame)."""

    kind = "ensemble"

    def __init__(self, **options):
        super().__init__(**options)
        self.detectors = {name: DETECTORS[kind](**own) for name, (kind, own) in options["members"].items()}

    def fit(self, df: DataFrame) -> Detector:
        for d in self.detectors.values():
            d.fit(df)
        weights = self.options.get("weights") or dict.fromkeys(self.detectors, 1.0)
        if self.options.get("learn_weights") and "is_anomaly" in df.columns:
            weights = {name: max(0.01, d.evaluate(df).first().f1) for name, d in self.detectors.items()}
        self.options["weights"] = weights
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return E.predict(df, self.detectors, self.options["weights"], self.options.get("strategy", "weighted_average"), self.options.get("key", "row_id"))

    def save(self, path: str) -> None:
        for name, d in self.detectors.items():
            d.save(f"{path}/{name}")
        _write_note(SparkSession.active(), path, {"kind": self.kind, "tables": [], "options": self.options})

    def restore(self, spark: SparkSession, path: str, note: dict) -> None:
        self.detectors = {name: Detector.load(spark, f"{path}/{name}") for name in note["options"]["members"]}


class AdaptiveDetector(Detector):
    """Profiles of the training frame's normal rows, kept as a table; statistical, contextual and collective scores of any frame against them.

    ``models``: the forest and the factor are fitted and kept as well, and the density noise is the predicted frame's own; without
    them their share of the weights adds nothing. ``weights``, ``sensitivity`` and ``improved``: the mix of scores, how far a row must be from a
    profile, and whether the second published set of both holds where they aren't given.
    """

    kind = "adaptive"

    def _sigmas(self) -> float:
        scale = D.IMPROVED_SENSITIVITY if self.options.get("improved") else P.SENSITIVITY
        return scale[self.options.get("sensitivity", "medium")]

    def _weights(self) -> dict[str, float]:
        given = self.options.get("weights") or (D.IMPROVED_WEIGHTS if self.options.get("improved") else D.WEIGHTS)
        return {c: w for c, w in given.items() if c != "ml_score" or self.options.get("models")}

    def _mix(self) -> str:
        return "share" if self.options.get("improved") else "sum"

    def fit(self, df: DataFrame) -> Detector:
        rows, features = df.withColumns(X.temporal(F.col("timestamp"))), self.options["features"]
        self.state["moments"] = D.normal_moments(rows, features, self.options.get("min_rows"))
        if self.options.get("models"):
            normal = df.where("is_anomaly = 0") if "is_anomaly" in df.columns else df
            self.state |= D.fit_ml(normal, features, self.options.get("key", "row_id"), self.options.get("trees", 100), self.options.get("neighbours", 20))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        rows, features = df.withColumns(X.temporal(F.col("timestamp"))), self.options["features"]
        raw = D.profile_scores(rows, self.state["moments"], features, self._sigmas())
        if self.options.get("models"):
            tables = {t: self.state[t] for t in ("scale", "nodes", "factor")}
            raw = staged(D.score_ml(raw, tables, features, self.options.get("key", "row_id"), self._mix(), self.options.get("eps", 0.5), self.options.get("neighbours", 20)), "adaptive_models")
        return D.combined(raw, self._weights())


#: Detectors as published scripts set them up.
PRESETS = {"enhanced_forest": ("forest", {"components": 0.95, "best_f1": True}), "standard_forest": ("forest", {"contamination": 0.2}), "improved_forest": ("forest", {"contamination": 0.2, "scale": True, "best_f1": True}), "factor": ("factor", {"contamination": 0.1})}


def preset(name: str, features: list[str], **options) -> Detector:
    kind, own = PRESETS[name]
    return DETECTORS[kind](**(own | {"features": features} | options))


for _c in (DosDetector, SequenceDetector, ProfileDetector, ForestDetector, FactorDetector, TextDetector, EnsembleDetector, AdaptiveDetector):
    register_detector(_c.kind, _c)


def reduced(df: DataFrame, features: list[str], variance: float = 0.95) -> tuple[DataFrame, list[str]]:
    """``df`` with as many principal components of its standardised features as explain the share of variance: columns pc_0, pc_1, ..."""
    projection = K.fit_projection(df, features, variance)
    return K.project(df, projection), K.names(projection)
