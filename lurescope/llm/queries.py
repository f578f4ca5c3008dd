"""Registered queries of the pipeline operators: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm import alignment, bytepairs, decontaminate, jaccardjoin, langid, linear, linededup, maintext, packing, pseudonyms, quality, substrings, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")



def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated_pairs(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_windows", "n_matched")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train_languages(docs, ~linear.held_out(F.col("doc_id")))
    return langid.predict_languages(docs, model).withColumn("held_out", linear.held_out(F.col("doc_id")))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(documents(spark, sf_dir), length=400)


def op5_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract_pages(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


#: Key of the registered query; a production run passes its own secret.
PSEUDONYM_KEY = "registered-query"


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def op9_jaccardjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.similar_documents(documents(spark, sf_dir), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), ~linear.held_out(F.col("doc_id")))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", linear.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(documents(spark, sf_dir))


def op13_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_substrings": op4_substrings,
    "op5_maintext": op5_maintext,
    "op6_packing": op6_packing,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_linededup": op8_linededup,
    "op9_jaccardjoin": op9_jaccardjoin,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_bytepairs": op13_bytepairs,
}

SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE,
    "op8_linededup": linededup.ORACLE,
}
