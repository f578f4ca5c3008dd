"""The registered queries: each operator over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.contract import FEATURES, NEIGHBOURS, RECENT_SCANS
from lurescope.functions import reports
from lurescope.functions.stats import metric_tag, sketch_value
from lurescope.operators import adaboost, classify, distribution, drift, gates, history, impute, metrics, quality, scale
from lurescope.operators import prepare, training, transcript
from lurescope.operators.dns import lookup_dns
from lurescope.operators.features import extract_features, feature_array, features_json, flag_mask, flagged, masked_names
from lurescope.operators.intake import check_feedback, check_intake
from lurescope.operators.patterns import distinct_rows, with_folds
from lurescope.functions.verdicts import with_verdict
from lurescope.plans import inputs, jobs
from lurescope.session import shared_folder, stored
from lurescope.sources import catalog, logs, store
from lurescope.sources.tables import conform, read_drift_inputs, read_table
from lurescope.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _r6(column: str):
    return F.round(column, 6).alias(column)


def heuristic(df: DataFrame) -> DataFrame:
    return classify.heuristic_classify(df, FEATURES)


def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristic(inputs.page_features(spark, sf_dir))


# --- URL features -----------------------------------------------------------


@query
def url_features(spark, sf_dir):
    return inputs.page_features(spark, sf_dir)


@query
def url_features_mutated(spark, sf_dir):
    return extract_features(inputs.url_variants(spark, sf_dir)).drop("url")


@query
def url_flag_summary(spark, sf_dir):
    """Flagship: authorities with the most phishing codes."""
    rows = extract_features(inputs.url_variants(spark, sf_dir), keep_parts=True)
    hits = sum((F.when(F.col(c) == -1, 1).otherwise(0) for c in FEATURES), F.lit(0))
    mask = flag_mask()
    per_host = rows.groupBy("netloc").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.sum(hits).alias("n_phishing_codes"),
        F.sum(F.bit_count(mask)).alias("n_flagged"),
        F.bit_or(mask).alias("mask"),
    )
    top = per_host.orderBy(F.desc("n_phishing_codes"), "netloc").limit(20)
    return top.withColumn("signals", F.array_join(masked_names(F.col("mask")), ",")).drop("mask")


@query
def flagged_signals(spark, sf_dir):
    rows = inputs.page_features(spark, sf_dir)
    return rows.select("page_id", F.array_join(flagged(), ",").alias("signals"))


@query
def url_parts(spark, sf_dir):
    rows = extract_features(inputs.url_variants(spark, sf_dir), keep_parts=True)
    return rows.select("page_id", "variant", "u", "netloc", "scheme", "port_no", "parse_error")


@query
def url_intake_rejects(spark, sf_dir):
    checked = check_intake(inputs.url_variants(spark, sf_dir))
    return checked.where(F.col("reject_reason").isNotNull()).select("page_id", "variant", "url", "reject_reason")


@query
def feature_vector(spark, sf_dir):
    """Codes in contract order; a column that is left out reads as safe."""
    rows = feature_array(inputs.page_features(spark, sf_dir).drop("URL_Length"))
    text = F.array_join(F.transform("feature_array", lambda x: x.cast("string")), ",")
    return rows.select("page_id", text.alias("vector_text"))


@query
def dns_enrich(spark, sf_dir):
    dns = inputs.dns_snapshot(spark, sf_dir)
    coded = extract_features(inputs.url_variants(spark, sf_dir), "url", dns)
    return lookup_dns(coded.select("page_id", "variant", "url", "DNSRecord"), dns).drop("url")


# --- drift ------------------------------------------------------------------


def _lineitem_counts(spark, sf_dir):
    return distribution.value_counts(inputs.lineitem_sides(spark, sf_dir), inputs.MEASURES)


@query
def drift_ks(spark, sf_dir):
    summary = distribution.summarise(distribution.cumulative_counts(_lineitem_counts(spark, sf_dir)), [])
    return summary.select("feature", "n_ref", "n_cur", _r6("ks_d"), _r6("ks_p"))


@query
def drift_ks_small(spark, sf_dir):
    """Balances of suppliers against customers per nation: few rows a side, where p is exact."""

    def side(table, prefix, is_ref):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return rows.select(F.col(f"{prefix}_nationkey").cast("string").alias("feature"), F.col(f"{prefix}_acctbal").cast("double").alias("value"), F.lit(is_ref).alias("is_ref"))

    both = side("supplier", "s", True).unionByName(side("customer", "c", False))
    counts = both.groupBy("feature", "value").agg(F.count_if("is_ref").alias("n_ref"), F.count_if(~F.col("is_ref")).alias("n_cur"))
    summary = distribution.summarise(distribution.cumulative_counts(counts), [])
    return summary.select("feature", "n_ref", "n_cur", _r6("ks_d"), _r6("ks_p"))


@query
def drift_psi(spark, sf_dir):
    return drift.drift_report_from_counts(_lineitem_counts(spark, sf_dir), inputs.MEASURES).select("feature", "psi")


@query
def histogram_counts(spark, sf_dir):
    cumulative = distribution.cumulative_counts(_lineitem_counts(spark, sf_dir))
    summary = distribution.summarise(cumulative, distribution.psi_shares())
    return distribution.histogram(cumulative, distribution.psi_edges(summary))


@query
def column_quantiles(spark, sf_dir):
    cumulative = distribution.cumulative_counts(_lineitem_counts(spark, sf_dir))
    q = distribution.summarise(cumulative, distribution.psi_shares())
    listed = q.select("feature", F.posexplode("quantiles").alias("decile", "value"))
    return listed.select("feature", "decile", _r6("value"))


@query
def drift_report(spark, sf_dir):
    return drift.drift_report_from_counts(_lineitem_counts(spark, sf_dir), inputs.MEASURES)


@query
def drift_summary(spark, sf_dir):
    return drift.drift_summary(drift_report(spark, sf_dir))


@query
def url_feature_drift(spark, sf_dir):
    """Features of plain-http URLs against those of https URLs."""
    rows = extract_features(inputs.url_variants(spark, sf_dir), keep_parts=True)
    rows = rows.withColumn("is_ref", F.col("scheme") == "http")
    return drift.drift_report_from_counts(distribution.value_counts(rows, FEATURES), FEATURES)


@query
def url_drift_summary(spark, sf_dir):
    return drift.drift_summary(url_feature_drift(spark, sf_dir))


@query
def validation_drift(spark, sf_dir):
    rows = inputs.labelled_pages(spark, sf_dir)
    cut = rows.withColumn("is_ref", F.col("SSLfinal_State") == -1)
    counts = distribution.value_counts(cut, [*FEATURES, "Result"])
    report = drift.validation_drift_from_counts(counts, [*FEATURES, "Result"])
    return report.select("column_name", _r6("p_value"), "drift_status")


@query
def validation_verdict(spark, sf_dir):
    rows = inputs.labelled_pages(spark, sf_dir).drop("page_id", "variant", "url")
    base, current = rows.where("SSLfinal_State = -1"), rows.where("SSLfinal_State = 1")
    return drift.drift_free(drift.validation_drift(base, current))


@query
def contract_check(spark, sf_dir):
    """A dataset whose test half lacks a column: everything goes to ``invalid``."""
    root = shared_folder(spark, "store")
    whole = inputs.labelled_pages(spark, sf_dir).drop("page_id", "variant", "url")
    splits = {"train": whole.where("SSLfinal_State = -1"), "test": whole.where("SSLfinal_State = 1").drop("Iframe")}
    verdict = quality.contract_verdict(splits)
    kind = store.route_splits(splits, verdict.first()["dataset_ok"], root, "r1")
    stored = spark.read.parquet(f"{root}/{kind}").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return verdict.join(stored, "split").withColumn("kind", F.lit(kind))


# --- preparation ------------------------------------------------------------


@query
def seeded_split(spark, sf_dir):
    return quality.seeded_split(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query
def split_counts(spark, sf_dir):
    pages = quality.seeded_split(inputs.page_urls(spark, sf_dir), "page_id")
    return pages.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("page_id").alias("id_sum"))


@query
def label_remap(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 - 1).alias("Result"))
    return quality.remap_label(rows, "Result")


@query
def column_means(spark, sf_dir):
    codes = inputs.lineitem_codes(spark, sf_dir)
    means = impute.column_means(impute.fit_donors(codes, inputs.CODES), inputs.CODES)
    return means.select(*[_r6(c) for c in inputs.CODES])


@query
def knn_impute(spark, sf_dir):
    codes = inputs.lineitem_codes(spark, sf_dir)
    filled = impute.knn_impute(codes, impute.fit_donors(codes, inputs.CODES), inputs.CODES, NEIGHBOURS)
    rounded = filled.select(*[_r6(c) for c in inputs.CODES])
    return rounded.groupBy(*inputs.CODES).agg(F.count(F.lit(1)).alias("n"))


@query
def robust_scale_params(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return scale.fit_robust_scale(li, inputs.MEASURES).select("feature", _r6("median"), _r6("iqr"), _r6("scale"))


@query
def robust_scale(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *inputs.MEASURES)
    scaled = scale.apply_robust_scale(li, scale.fit_robust_scale(li, inputs.MEASURES), inputs.MEASURES)
    return scaled.select("l_orderkey", "l_linenumber", *[_r6(c) for c in inputs.MEASURES])


@query
def distinct_row_folds(spark, sf_dir):
    rows = distinct_rows(inputs.labelled_pages(spark, sf_dir), FEATURES, "Result")
    dealt = with_folds(rows, FEATURES, training.FOLDS)
    return dealt.groupBy("label").agg(F.sum("copies").alias("n_rows"))


# --- metrics and gates ------------------------------------------------------


def _rule_metrics(rows: DataFrame) -> DataFrame:
    long = rows.unpivot(["doc_id", "label"], list(inputs.RULES), "model", "prediction")
    return metrics.classification_metrics(long, "label", "prediction", ["model"])


@query
def weighted_metrics(spark, sf_dir):
    table = _rule_metrics(inputs.rule_predictions(spark, sf_dir))
    return table.select("model", "n_rows", *[_r6(m) for m in ("accuracy", "precision", "recall", "f1")])


@query
def best_model(spark, sf_dir):
    rows = quality.seeded_split(inputs.rule_predictions(spark, sf_dir), "doc_id")
    long = rows.unpivot(["doc_id", "label", "is_test"], list(inputs.RULES), "model", "prediction")
    f1 = metrics.classification_metrics(long, "label", "prediction", ["model", "is_test"])
    ordinal = F.array_position(F.array(*map(F.lit, inputs.RULES)), F.col("model")).cast("int") - 1
    report = f1.groupBy("model", ordinal.alias("ordinal")).agg(
        F.round(F.max(F.when(~F.col("is_test"), F.col("f1"))), 6).alias("train_f1"),
        F.round(F.max(F.when(F.col("is_test"), F.col("f1"))), 6).alias("test_f1"),
    )
    return gates.best_model(report)


def _rounded_gate(gate: DataFrame) -> DataFrame:
    numbers = [_r6(c) for c in ("candidate_f1", "champion_f1", "improvement")]
    return gate.select("accepted", *numbers, "promoted_version")


@query
def champion_gate(spark, sf_dir):
    rows = inputs.rule_predictions(spark, sf_dir)
    return _rounded_gate(gates.champion_gate(rows, "label", "short", "medium", "7"))


@query
def first_champion_gate(spark, sf_dir):
    rows = inputs.rule_predictions(spark, sf_dir)
    return _rounded_gate(gates.champion_gate(rows, "label", "medium", None, "1"))


def _catalog_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Versions and aliases derived from the rules' scores per document source."""
    rows = inputs.rule_predictions(spark, sf_dir)
    f1 = metrics.classification_metrics(rows, "label", "medium", ["source"])
    version = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    alias = F.when(F.col("n_rows") % 2 == 0, "production").otherwise("staging")
    when = F.timestamp_seconds(F.lit(1700000000) + F.col("n_rows") * 3600)
    base = f1.select(
        F.lit(catalog.MODEL_NAME).alias("name"),
        version.alias("version"),
        F.concat(F.lit("run-"), F.col("source")).alias("run_id"),
        alias.alias("alias"),
        metric_tag(F.round("f1", 6)).alias("test_f1"),
        when.alias("updated_at"),
        F.round("f1", 6).alias("f1"),
    )
    return base.select("name", "version", "run_id", "f1"), base.select("name", "alias", "version", "test_f1", "updated_at")


@query
def champion_lookup(spark, sf_dir):
    return catalog.production_info(*_catalog_tables(spark, sf_dir))


@query
def latest_version(spark, sf_dir):
    return catalog.latest_version(_catalog_tables(spark, sf_dir)[0])


@query
def stored_metric_gate(spark, sf_dir):
    versions, aliases = _catalog_tables(spark, sf_dir)
    candidates = versions.select("version", F.col("f1").alias("test_f1"))
    return gates.stored_metric_gate(candidates, catalog.current_alias(aliases))


# --- verdicts, reports, history ---------------------------------------------


@query
def verdicts(spark, sf_dir):
    log = inputs.scan_log(spark, sf_dir).select("id", F.col("probability").alias("p_phishing"))
    return with_verdict(log).select("id", "prediction", "label", "phishing_probability", "confidence", "needs_review")


@query
def confidence_bands(spark, sf_dir):
    bands = verdicts(spark, sf_dir).groupBy("confidence", "needs_review", "label")
    return bands.agg(F.count(F.lit(1)).alias("n"))


@query
def scan_history_topk(spark, sf_dir):
    rows = history.scan_history(inputs.scan_log(spark, sf_dir))
    code = F.col("features_map.URL_Length").alias("url_length_code")
    return rows.select("id", "url", "prediction", _r6("probability"), "features", code, "created_at")


@query
def history_for_url(spark, sf_dir):
    log = inputs.scan_log(spark, sf_dir)
    recent = history.newest(log, RECENT_SCANS)
    busiest = recent.groupBy("url").count().orderBy(F.desc("count"), "url").select("url").first()["url"]
    return history.url_history(log, busiest).select("id", "url", "prediction", "created_at")


def _summary_text(df: DataFrame) -> DataFrame:
    return df.withColumn("past_verdicts", F.array_join("past_verdicts", ","))


@query
def history_summary(spark, sf_dir):
    return _summary_text(history.history_summary(inputs.scan_log(spark, sf_dir), None))


@query
def history_enrich(spark, sf_dir):
    log = inputs.scan_log(spark, sf_dir)
    users = read_table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("http://site"), F.col("c_custkey").cast("string"), F.lit(".example.com/")).alias("url"),
    )
    return _summary_text(history.with_history(users, log, None))


@query
def feedback_intake(spark, sf_dir):
    checked = check_feedback(inputs.feedback_input(spark, sf_dir))
    return checked.groupBy("accepted", "correct_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


@query
def feedback_log(spark, sf_dir):
    rows, _ = logs.prepare_feedback(inputs.feedback_input(spark, sf_dir))
    return rows.select("row", "url", "predicted_label", "correct_label", "features")


@query
def feedback_history(spark, sf_dir):
    rows, _ = logs.prepare_feedback(inputs.feedback_input(spark, sf_dir))
    log = rows.withColumn("id", F.lpad(F.col("row").cast("string"), 12, "0"))
    return history.feedback_history(log).select("id", "url", "predicted_label", "correct_label", "created_at")


@query
def feedback_training_rows(spark, sf_dir):
    rows, _ = logs.prepare_feedback(inputs.feedback_input(spark, sf_dir))
    contract = jobs.feedback_rows(rows)
    return contract.groupBy(*FEATURES, "Result").agg(F.count(F.lit(1)).alias("n"))


@query
def report_markdown(spark, sf_dir):
    return reports.with_report(scored_pages(spark, sf_dir)).select("page_id", "ai_analysis")


@query
def report_dedup(spark, sf_dir):
    rows = heuristic(extract_features(inputs.url_variants(spark, sf_dir)))
    firsts = reports.distinct_reports(rows, ["page_id", "variant"])
    return firsts.select("key", "n_scans", F.col("first.page_id").alias("first_page"), "ai_analysis")


@query
def prompt_dataset(spark, sf_dir):
    text = reports.analyst_prompt(F.col("url"), F.col("prediction"), F.col("p_phishing"))
    return scored_pages(spark, sf_dir).select("page_id", text.alias("prompt"))


@query
def investigation_report(spark, sf_dir):
    """Evidence of all four tools per page; scans of a host count for its pages."""
    log, dns = inputs.variant_scans(spark, sf_dir), inputs.dns_snapshot(spark, sf_dir)
    rows = jobs.investigate_urls(inputs.page_urls(spark, sf_dir), heuristic, log, dns)
    return _summary_text(rows).select(
        "page_id", "dns_domain", "dns_resolves", "dns_ip", "previous_scans", "past_verdicts", "agentic", "report"
    )


@query
def transcript_parts(spark, sf_dir):
    return transcript.fold_transcripts(read_table(spark, sf_dir, "conversations"))


@query
def chat_prompts(spark, sf_dir):
    """The last user turn is the open question, the turns before it the history."""
    turns = read_table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.max_by("text", "turn").alias("message")
    )
    earlier = turns.join(asked.select("conv_id", "last"), "conv_id").where(F.col("turn") < F.col("last")).drop("last")
    return transcript.chat_prompts(earlier, asked.select("conv_id", "message"))


# --- stored tables ----------------------------------------------------------


@query
def scan_log_roundtrip(spark, sf_dir):
    """Scores every page, appends to a new scan log and reads it back."""
    root = shared_folder(spark, "scan-log")
    logs.ensure_logs(spark, root)
    scored, _ = jobs.score_urls(inputs.page_urls(spark, sf_dir), heuristic)
    logs.log_scans(scored, root, "first")
    logs.log_scans(scored, root, "first")  # a repeated batch is stored once
    return logs.read_log(spark, root, "scan_history").select("url", "prediction", _r6("probability"), "features")


@query
def log_compaction_roundtrip(spark, sf_dir):
    """The scan log in batches, some folded, one written again and one new; read back whole."""
    root = shared_folder(spark, "compacted-log")
    logs.ensure_logs(spark, root)
    scored = stored(jobs.score_urls(inputs.page_urls(spark, sf_dir), heuristic)[0])
    share = F.pmod(F.xxhash64("url"), F.lit(3))
    for k in (0, 1):
        logs.log_scans(scored.where(share == k), root, f"batch-{k}")
    logs.compact_log(spark, root, "scan_history")
    logs.vacuum_log(spark, root, "scan_history")
    for k in (1, 2):
        logs.log_scans(scored.where(share == k), root, f"batch-{k}")
    logs.compact_log(spark, root, "scan_history")
    return logs.read_log(spark, root, "scan_history").select("url", "prediction", _r6("probability"), "features")


@query
def catalog_roundtrip(spark, sf_dir):
    """A version for each of the rules' champions, promoted if better; the catalog's own view of the champion."""
    root = shared_folder(spark, "catalog")
    rules = metrics.classification_metrics(inputs.rule_predictions(spark, sf_dir), "label", "medium", [])
    f1 = round(rules.first()["f1"], 6)
    for k, share in enumerate((0.5, 1.0, 0.75)):
        version = catalog.register_version(spark, root, f"run-{k}", f"models/{k}")
        catalog.promote_if_better(spark, root, version, f1 * share)
    return catalog.production_info(catalog.read_versions(spark, root), catalog.read_aliases(spark, root))


@query
def feature_store_roundtrip(spark, sf_dir):
    """Snapshot, split and routing of the labelled rows, read back."""
    root = shared_folder(spark, "store")
    rows = inputs.labelled_pages(spark, sf_dir).drop("page_id", "variant", "url")
    store.write_snapshot(rows, root, "r1")
    store.write_splits(quality.seeded_split(store.read_snapshot(spark, root, "r1"), "row_id"), root, "r1")
    splits = {s: store.read_split(spark, root, "r1", s).drop("row_id") for s in ("train", "test")}
    kind = store.route_splits(splits, quality.contract_verdict(splits).first()["dataset_ok"], root, "r1")
    stored = spark.read.parquet(f"{root}/{kind}")
    return stored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.lit(kind).alias("kind"))


def _source_runs(spark, sf_dir):
    rows = metrics.classification_metrics(inputs.rule_predictions(spark, sf_dir), "label", "medium", ["source"])
    return rows.select(
        F.col("source").alias("id"),
        F.concat(F.lit("run-"), F.col("source")).alias("run_id"),
        _r6("accuracy"),
        F.round("f1", 6).alias("f1_score"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("n_rows")).alias("created_at"),
    )


@query
def run_history(spark, sf_dir):
    """Sources as training runs: the newest ten."""
    return history.run_history(_source_runs(spark, sf_dir))


@query
def dataset_roundtrip(spark, sf_dir):
    """The labelled rows as CSV with a header, read as both sides of a drift run and cast to the contract."""
    path = shared_folder(spark, "dataset") + ".csv"
    inputs.labelled_pages(spark, sf_dir).select(*FEATURES, "Result").write.option("header", True).csv(path)
    base, current = (conform(side) for side in read_drift_inputs(spark, path))
    sides = base.withColumn("side", F.lit("reference")).unionByName(current.withColumn("side", F.lit("current")))
    return sides.groupBy("side", "Result").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in FEATURES])


@query
def drift_report_roundtrip(spark, sf_dir):
    """The drift report as a JSON sink of two runs, one written again; the second run's read back."""
    root = shared_folder(spark, "reports")
    report = stored(drift_report(spark, sf_dir))
    for run_id in ("r1", "r2", "r2"):
        path = store.write_report(report, root, "drift_report", run_id)
    written = spark.read.schema(report.schema.add("run_id", "string")).json(path)
    return written.where("run_id = 'r2'").drop("run_id")


@query
def matrix_roundtrip(spark, sf_dir):
    """Scaled measures as the stored matrix of both splits."""
    root = shared_folder(spark, "matrix")
    scaled = stored(robust_scale(spark, sf_dir))
    is_test = F.col("l_orderkey") % 5 == 0
    store.write_matrix(scaled.where(is_test), root, "r1", "test")
    store.write_matrix(scaled.where(~is_test), root, "r1", "train")
    return spark.read.parquet(f"{root}/matrix").drop("run_id")


@query
def preprocessor_roundtrip(spark, sf_dir):
    """Imputer and scaler fitted on the coded rows, saved, loaded and applied."""
    path = shared_folder(spark, "preprocessor")
    codes = inputs.lineitem_codes(spark, sf_dir)
    prepare.Preprocessor(inputs.CODES).fit(codes).save(path)
    ready = prepare.PreprocessorModel.load(spark, path).transform(codes)
    rounded = ready.select(*[F.round(c, 4).alias(c) for c in inputs.CODES])
    return rounded.groupBy(*inputs.CODES).agg(F.count(F.lit(1)).alias("n"))


@query
def run_log_roundtrip(spark, sf_dir):
    """Sources as training runs, appended to the run log; its newest ten."""
    root = shared_folder(spark, "run-log")
    logs.ensure_logs(spark, root)
    runs = _source_runs(spark, sf_dir).withColumn("model_path", F.concat(F.lit("models/"), "run_id"))
    for batch in ("first", "first"):  # a repeated batch is stored once
        logs.append_log(runs, root, "pipeline_runs", batch)
    return history.run_history(logs.read_log(spark, root, "pipeline_runs").drop("model_path"))


# --- learning ---------------------------------------------------------------

BOOSTING_ROUNDS = 50  # the first of the published round counts


@query
def train_models(spark, sf_dir):
    """Model report over all labelled URL variants, with the published grids."""
    rows = inputs.labelled_pages(spark, sf_dir)
    keyed = rows.withColumn("row_key", F.concat_ws("/", "page_id", "variant"))
    split = quality.remap_label(quality.seeded_split(keyed, "row_key"), "Result")
    results = training.train_models(split.where("not is_test"), split.where("is_test"), FEATURES, "Result")
    report = training.model_report(spark, results)
    return report.select("model", "ordinal", _r6("train_f1"), _r6("test_f1"), _r6("test_accuracy"))


@query
def adaboost_rounds(spark, sf_dir):
    rows = quality.remap_label(inputs.labelled_pages(spark, sf_dir), "Result")
    stumps = adaboost.fit_adaboost(distinct_rows(rows, FEATURES, "Result"), FEATURES, BOOSTING_ROUNDS)
    table = adaboost.stump_table(spark, stumps)
    return table.withColumns({"alpha": F.round("alpha", 6), "threshold": F.round("threshold", 6)})


@query
def model_scores(spark, sf_dir):
    """Every page scored by a boosted model trained on the URL variants."""
    rows = quality.remap_label(inputs.labelled_pages(spark, sf_dir), "Result")
    stumps = adaboost.fit_adaboost(distinct_rows(rows, FEATURES, "Result"), FEATURES, BOOSTING_ROUNDS)
    scored = classify.RiskModel(FEATURES, None, stumps).classify(inputs.page_features(spark, sf_dir))
    return scored.select("page_id", "prediction", "label", "phishing_probability", "confidence", "needs_review")


@query
def champion_scores(spark, sf_dir):
    """A short and a full boosting saved and registered, the better one promoted, loaded as champion; every page scored by it."""
    root = shared_folder(spark, "champion")
    rows = quality.remap_label(inputs.labelled_pages(spark, sf_dir), "Result")
    stumps = adaboost.fit_adaboost(distinct_rows(rows, FEATURES, "Result"), FEATURES, BOOSTING_ROUNDS)
    for run_id, rounds in (("short", 1), ("full", BOOSTING_ROUNDS)):
        path = f"{root}/models/{run_id}"
        classify.RiskModel(FEATURES, None, stumps[:rounds]).save(spark, path)
        version = catalog.register_version(spark, root, run_id, path)
        catalog.promote_if_better(spark, root, version, rounds / (rounds + 1))
    champion = jobs.load_champion(spark, root)
    scored = champion.classify(inputs.page_features(spark, sf_dir))
    return scored.select("page_id", "prediction", "label", "phishing_probability", "confidence", "needs_review")


# --- streams ----------------------------------------------------------------


def _stream(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return streams.read_stream(spark, f"{sf_dir}/{name}*.parquet", schema)


@query
def stream_scan_parity(spark, sf_dir):
    """The pages as a stream of scans, read back from the scan log."""
    root = shared_folder(spark, "stream-scan")
    logs.ensure_logs(spark, root)
    urls = _stream(spark, sf_dir, "pages").select("page_id", "url")
    streams.score_stream(urls, heuristic, root, f"{root}/checkpoint").awaitTermination()
    return logs.read_log(spark, root, "scan_history").select("url", "prediction", _r6("probability"), "features")


@query
def stream_enrich(spark, sf_dir):
    """DNS and history joined to the stream itself; each page counts its whole history."""
    root = shared_folder(spark, "stream-enrich")
    dns = inputs.dns_snapshot(spark, sf_dir)
    urls = _stream(spark, sf_dir, "pages").select("page_id", "url")
    rows = lookup_dns(extract_features(urls, "url", dns), dns)
    rows = history.with_history(rows, inputs.variant_scans(spark, sf_dir), None)
    out = rows.select("page_id", "DNSRecord", "dns_resolves", "previous_scans", "past_verdicts")
    sink = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/rows")
    sink.trigger(availableNow=True).start().awaitTermination()
    return _summary_text(spark.read.parquet(f"{root}/rows"))


@query
def stream_history(spark, sf_dir):
    """The events' scan log arrives in several batches, in no order of time; the stream's own state is the history."""
    root = shared_folder(spark, "stream-history")
    scans = inputs.scan_log(spark, sf_dir).select("id", "url", "prediction", "created_at")
    order = F.pmod(F.xxhash64("id"), F.lit(3))
    for k in (2, 1, 0):
        scans.where(order == k).write.mode("append").parquet(f"{root}/arriving")
    arriving = streams.read_stream(spark, f"{root}/arriving", scans.schema, files_per_batch=8)
    streams.history_stream(arriving, root, f"{root}/checkpoint").awaitTermination()
    return _summary_text(streams.live_history(spark, root))


@query
def stream_feedback(spark, sf_dir):
    root = shared_folder(spark, "stream-feedback")
    logs.ensure_logs(spark, root)
    e = _stream(spark, sf_dir, "events")
    feedback = e.select(
        F.concat(F.lit("http://site"), F.col("user_id").cast("string"), F.lit("-x.example.com/")).alias("url"),
        F.when(F.col("event_type") != "view", F.when(F.col("value") > 100, 0).otherwise(1)).alias("predicted_label"),
        (F.col("event_id") % 4).cast("int").alias("correct_label"),
    )
    streams.feedback_stream(feedback, root, f"{root}/checkpoint").awaitTermination()
    stored = logs.read_log(spark, root, "feedback").select("predicted_label", "correct_label", F.lit(True).alias("accepted"))
    rejected = spark.read.parquet(f"{root}/rejected_feedback").select(
        "predicted_label", "correct_label", F.lit(False).alias("accepted")
    )
    both = stored.unionByName(rejected)
    return both.groupBy("accepted", "correct_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_drift(spark, sf_dir):
    """Daily counts of banded event values against purchases as the reference.

    The events arrive as many files, newest first, one per micro-batch.
    """
    root = shared_folder(spark, "stream-drift")
    events = read_table(spark, sf_dir, "events")
    span = events.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last")).first()
    quarter = F.floor(F.datediff(F.to_date("ts"), F.lit(span["first"])) * 4 / ((span["last"] - span["first"]).days + 1))
    for k in (3, 2, 1, 0):
        events.where(quarter == k).write.mode("append").parquet(f"{root}/arriving")
    band = F.when(F.col("value") > 100, -1).when(F.col("value") > 30, 0).otherwise(1)
    hour = F.hour("ts") % 3 - 1
    arriving = streams.read_stream(spark, f"{root}/arriving", events.schema, files_per_batch=1)
    stream = arriving.select("ts", band.alias("value_band"), hour.alias("hour_band"))
    columns = ["value_band", "hour_band"]
    streams.drift_stream(stream, root, f"{root}/checkpoint", columns).awaitTermination()
    fixed = read_table(spark, sf_dir, "events").where("event_type = 'purchase'")
    fixed = fixed.select(band.cast("double").alias("value_band"), hour.cast("double").alias("hour_band"))
    reference = fixed.unpivot([], columns, "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return streams.stored_drift(spark, root, reference, columns)


EVENT_LATENESS_DAYS = 5


@query
def stream_event_days(spark, sf_dir):
    """Daily counts by event time, with a watermark; values are sketched. What came too late is counted apart.

    Events arrive in five rounds by date; of every ten, one arrives a round late and one in the last round.
    """
    root = shared_folder(spark, "stream-event-days")
    events = read_table(spark, sf_dir, "events")
    span = events.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last")).first()
    quarter = F.floor(F.datediff(F.to_date("ts"), F.lit(span["first"])) * 4 / ((span["last"] - span["first"]).days + 1))
    turn = F.col("event_id") % 10
    arrival = F.when(turn == 3, quarter + 1).when(turn == 7, F.lit(4)).otherwise(quarter)
    columns = ["value_band", "value_sketch"]
    band = F.when(F.col("value") > 100, -1).when(F.col("value") > 30, 0).otherwise(1)
    for k in range(5):
        events.where(arrival == k).write.mode("append").parquet(f"{root}/arriving")
        arriving = streams.read_stream(spark, f"{root}/arriving", events.schema, files_per_batch=1_000_000)
        stream = arriving.select("ts", band.alias("value_band"), sketch_value(F.col("value")).alias("value_sketch"))
        lateness = f"{EVENT_LATENESS_DAYS} days"
        streams.event_time_drift_stream(stream, root, f"{root}/checkpoint", columns, lateness=lateness).awaitTermination()
    late = streams.late_rows(spark, root).select("day", F.lit("late").alias("feature"), F.lit(None).cast("double").alias("value"), "n")
    both = streams.event_day_counts(spark, root).unionByName(late)
    return both.withColumns({"day": F.col("day").cast("string"), "value": F.round("value", 4)})
