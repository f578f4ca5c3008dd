"""Preprocessor: impute, then scale; fitted on the training rows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.contract import FEATURES, NEIGHBOURS
from lurescope.operators.impute import column_means, fit_donors, knn_impute
from lurescope.operators.scale import apply_robust_scale, fit_robust_scale
from lurescope.session import stored


@dataclass
class Preprocessor:
    """Unfitted settings; :meth:`fit` returns the fitted pair of tables."""

    columns: list[str] | None = None
    neighbours: int = NEIGHBOURS

    def fit(self, train: DataFrame) -> PreprocessorModel:
        columns = self.columns or FEATURES
        donors = fit_donors(train, columns)
        means = column_means(donors, columns)
        # The donors are the training rows with their counts, so the scale is fitted on
        # them as well and the training table itself is read once.
        rows = donors.select(*[F.get("donor", F.lit(i)).alias(c) for i, c in enumerate(columns)], "copies")
        filled = knn_impute(rows, donors, columns, self.neighbours, means)
        scale = stored(fit_robust_scale(filled, columns, "copies"))
        return PreprocessorModel(columns, self.neighbours, donors, means, scale)


@dataclass
class PreprocessorModel:
    columns: list[str]
    neighbours: int
    donors: DataFrame
    means: DataFrame
    scale: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        filled = knn_impute(df, self.donors, self.columns, self.neighbours, self.means)
        return apply_robust_scale(filled, self.scale, self.columns)

    def save(self, path: str) -> None:
        """Three Parquet tables under ``path``; their size follows the distinct rows."""
        self.donors.write.mode("overwrite").parquet(f"{path}/donors")
        self.means.write.mode("overwrite").parquet(f"{path}/means")
        self.scale.write.mode("overwrite").parquet(f"{path}/scale")

    @staticmethod
    def load(spark: SparkSession, path: str, neighbours: int = NEIGHBOURS) -> PreprocessorModel:
        donors, means, scale = (spark.read.parquet(f"{path}/{t}") for t in ("donors", "means", "scale"))
        return PreprocessorModel(means.columns, neighbours, donors, means, scale)
