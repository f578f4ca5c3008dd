"""Model catalog: append-only tables of versions and aliases.

A version number belongs to the writer that created its marker under ``model_claims``, so two writers never share one.
A writer that is lost between its claim and its row leaves a number without a version; the next writer takes the one
after it. Each append has a folder of its own: writers that share one would clear away each other's unfinished files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.contract import FEATURES, MODEL_ALIASES, MODEL_VERSIONS, PRODUCTION_ALIAS
from lurescope.functions.stats import metric_tag
from lurescope.operators.gates import stored_metric_gate
from lurescope.sources.markers import put_if_absent

MODEL_NAME = "url-risk"


def ensure_catalog(spark: SparkSession, root: str) -> None:
    for table, schema in (("model_versions", MODEL_VERSIONS), ("model_aliases", MODEL_ALIASES)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{table}")


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MODEL_VERSIONS).option("recursiveFileLookup", True).parquet(f"{root}/model_versions")


def read_aliases(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MODEL_ALIASES).option("recursiveFileLookup", True).parquet(f"{root}/model_aliases")


def latest_version(versions: DataFrame) -> DataFrame:
    """(name, version): the highest version number per model."""
    return versions.groupBy("name").agg(F.max(F.col("version").cast("int")).alias("version"))


def current_alias(aliases: DataFrame, alias: str = PRODUCTION_ALIAS) -> DataFrame:
    """(name, version, test_f1) that the alias points at now: the last row written."""
    newest = F.max_by(F.struct("version", "test_f1"), F.struct("updated_at", "version"))
    return (
        aliases.where(F.col("alias") == alias).groupBy("name").agg(newest.alias("v")).select("name", "v.version", "v.test_f1")
    )


def production_info(versions: DataFrame, aliases: DataFrame, alias: str = PRODUCTION_ALIAS) -> DataFrame:
    """(name, version, test_f1, run_id) of the champion; no row when there is none."""
    return current_alias(aliases, alias).join(versions.select("name", "version", "run_id"), ["name", "version"])


def claim_version(spark: SparkSession, root: str, first: int, name: str = MODEL_NAME) -> int:
    """The first free version number from ``first``, now this writer's."""
    version = first
    while not put_if_absent(spark, f"{root}/model_claims/{name}/{version}"):
        version += 1
    return version


def register_version(spark: SparkSession, root: str, run_id: str, model_path: str, name: str = MODEL_NAME) -> int:
    """Append the next free version; the stored schema is that of the 30 features."""
    ensure_catalog(spark, root)
    row = latest_version(read_versions(spark, root)).where(F.col("name") == name).first()
    version = claim_version(spark, root, (row["version"] if row else 0) + 1, name)
    schema = json.dumps([{"name": c, "type": "long"} for c in FEATURES])
    new = spark.createDataFrame([(name, version, run_id, model_path, schema)], MODEL_VERSIONS.fieldNames()[:5])
    typed = new.withColumn("created_at", F.current_timestamp())
    typed.select(*[F.col(f.name).cast(f.dataType) for f in MODEL_VERSIONS]).write.parquet(
        f"{root}/model_versions/{name}-{version}-{uuid.uuid4().hex}"
    )
    return version


def set_production(spark: SparkSession, root: str, version: int, f1: float, name: str = MODEL_NAME) -> None:
    """Point the production alias at a version and tag it with its F1."""
    new = spark.createDataFrame([(name, PRODUCTION_ALIAS, version, f1)], "name string, alias string, version int, f1 double")
    rows = new.select("name", "alias", "version", metric_tag(F.col("f1")).alias("test_f1"), F.current_timestamp().alias("updated_at"))
    rows.write.parquet(f"{root}/model_aliases/{name}-{uuid.uuid4().hex}")


def promote_if_better(spark: SparkSession, root: str, version: int, f1: float, name: str = MODEL_NAME) -> bool:
    """Promote when there is no champion or its stored F1 is not higher."""
    candidate = spark.createDataFrame([(version, f1)], "version int, test_f1 double")
    champion = current_alias(read_aliases(spark, root)).where(F.col("name") == name)
    promote = stored_metric_gate(candidate, champion).first()["promote"]
    if promote:
        set_production(spark, root, version, f1, name)
    return promote
