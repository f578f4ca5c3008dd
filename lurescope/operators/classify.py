"""The composite model (preprocessor + classifier) and batch scoring with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.functions.verdicts import with_verdict
from lurescope.operators.adaboost import Stump, apply_adaboost, stump_table, stumps_from_table
from lurescope.operators.ensembles import Ensemble
from lurescope.operators.features import assemble
from lurescope.operators.prepare import PreprocessorModel

PHISHING_CLASS = 0


def class_probabilities(df: DataFrame) -> Column:
    """[P(0), P(1)] of a scored row; a model without probabilities gives [1-p, p]."""
    types = dict(df.dtypes)
    if types.get("probability") == "vector":
        return vector_to_array("probability")
    if "probability" in types:
        return F.col("probability")
    guess = F.col("prediction").cast("double")
    return F.array(F.lit(1.0) - guess, guess)


def phishing_probability(df: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """Add ``p_phishing``: the share of class 0, or of the first class without one."""
    index = classes.index(PHISHING_CLASS) if classes and PHISHING_CLASS in classes else 0
    return df.withColumn("p_phishing", F.get(class_probabilities(df), F.lit(index)))


@dataclass
class RiskModel:
    """A fitted preprocessor with trees, a list of boosted stumps or an MLlib pipeline."""

    columns: list[str]
    preprocessor: PreprocessorModel | None
    classifier: Ensemble | list[Stump] | PipelineModel

    def predict_prepared(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``probability`` to rows that are already transformed."""
        if isinstance(self.classifier, list):
            return apply_adaboost(df, self.classifier)
        if isinstance(self.classifier, Ensemble):
            return self.classifier.apply(df, self.columns)
        scored = self.classifier.transform(assemble(df, self.columns))
        scored = scored.withColumn("probability", class_probabilities(scored))
        return scored.drop("vector", "rawPrediction")

    def predict(self, df: DataFrame) -> DataFrame:
        """Score raw feature rows; the original codes stay in the result."""
        if self.preprocessor is None:
            return self.predict_prepared(df)
        raw = F.struct(*[F.col(c) for c in self.columns])
        prepared = self.preprocessor.transform(df.withColumn("_raw", raw))
        scored = self.predict_prepared(prepared)
        return scored.withColumns({c: F.col(f"_raw.{c}") for c in self.columns}).drop("_raw")

    def classify(self, df: DataFrame) -> DataFrame:
        """Feature rows -> p_phishing, verdict, confidence and review flag."""
        return with_verdict(phishing_probability(self.predict(df)))

    def save(self, spark: SparkSession, path: str) -> None:
        if self.preprocessor is not None:
            self.preprocessor.save(f"{path}/preprocessor")
        kind, combine, rate, base = "classifier", None, None, None
        if isinstance(self.classifier, list):
            kind = "stumps"
            stump_table(spark, self.classifier).coalesce(1).write.mode("overwrite").parquet(f"{path}/stumps")
        elif isinstance(self.classifier, Ensemble):
            kind, combine, rate, base = "trees", self.classifier.kind, self.classifier.rate, self.classifier.base
            self.classifier.node_table(spark).write.mode("overwrite").parquet(f"{path}/trees")
        else:
            self.classifier.write().overwrite().save(f"{path}/classifier")
        info = [(kind, self.preprocessor is not None, self.columns, combine, rate, base)]
        shape = "kind string, prepared boolean, columns array<string>, combine string, rate double, base double"
        spark.createDataFrame(info, shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/info")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RiskModel:
        info = spark.read.parquet(f"{path}/info").first()
        prepared = PreprocessorModel.load(spark, f"{path}/preprocessor") if info["prepared"] else None
        if info["kind"] == "stumps":
            classifier = stumps_from_table(spark.read.parquet(f"{path}/stumps"))
        elif info["kind"] == "trees":
            classifier = Ensemble.from_table(spark.read.parquet(f"{path}/trees"), info["combine"], info["rate"], info["base"])
        else:
            classifier = PipelineModel.load(f"{path}/classifier")
        return RiskModel(list(info["columns"]), prepared, classifier)


def heuristic_classify(df: DataFrame, columns: list[str]) -> DataFrame:
    """A stand-in classifier for jobs without a model: p grows with the flagged codes."""
    hits = sum((F.when(F.col(c) < 1, 1).otherwise(0) for c in columns), F.lit(0))
    return with_verdict(df.withColumn("p_phishing", hits / (hits + 3)))


Classifier = Callable[[DataFrame], DataFrame]
