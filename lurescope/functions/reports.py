"""Report texts as column expressions: structured report, markdown, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.contract import FEATURES
from lurescope.functions.stats import percent_text
from lurescope.functions.verdicts import label_text
from lurescope.operators.features import features_json, flag_mask, flagged, masked_names

# --- Fixed values: wording and layout of the published reports --------------
VERDICT_TEXT = {0: "PHISHING / SUSPICIOUS", 1: "LEGITIMATE / SAFE"}
RISK_LEVEL = {0: "HIGH", 1: "SAFE"}
NO_SIGNALS = "No suspicious structural signals detected."
BRAND_RISK = {
    0: "Potential brand-impersonation indicators present.",
    1: "No strong impersonation indicators.",
}
ADVICE = {
    0: [
        "Do not enter credentials or personal data on this site.",
        "Verify the domain against the official source.",
        "Report the URL to your security team.",
    ],
    1: ["No action required, but stay vigilant for look-alike domains."],
}
SUMMARY_FORMAT = (
    "This URL was classified as %s by the phishing-detection model with a %s phishing probability. "
    "This is an offline heuristic summary."
)
REPORT_TITLE = "### 🛡️ L2 AI Threat Report"
DEFAULT_SIGNAL, DEFAULT_RISK, DEFAULT_ADVICE = "* None detected.", "Not assessed.", "* Stay vigilant."
INVESTIGATION_TITLE = "### 🧠 Agentic Investigation (offline)"
# --- end of fixed values ----------------------------------------------------

OFFLINE_NOTE = "No live tools were run; the evidence columns of this row hold what the tables know."
PROMPT_PREAMBLE = "Analyse the URL and write a concise threat report."


def by_prediction(prediction: Column, texts: dict) -> Column:
    phishing, safe = (F.array(*map(F.lit, t)) if isinstance(t, list) else F.lit(t) for t in (texts[0], texts[1]))
    return F.when(prediction == 0, phishing).otherwise(safe)


def threat_report(prediction: Column, p: Column, signals: Column) -> Column:
    """The structured report of a scored row, without any model call."""
    verdict = by_prediction(prediction, VERDICT_TEXT)
    return F.struct(
        by_prediction(prediction, RISK_LEVEL).alias("risk_level"),
        F.format_string(SUMMARY_FORMAT, verdict, percent_text(p)).alias("summary"),
        F.when(F.size(signals) > 0, signals).otherwise(F.array(F.lit(NO_SIGNALS))).alias("structural_signals"),
        by_prediction(prediction, BRAND_RISK).alias("typosquatting_risk"),
        by_prediction(prediction, ADVICE).alias("recommendations"),
    )


def bullets(items: Column, default: str) -> Column:
    listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit("* "), x)), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, listed).otherwise(F.lit(default))


def markdown(report: Column, p: Column) -> Column:
    """A report struct as markdown text."""
    risk = report["typosquatting_risk"]
    return F.concat(
        F.lit(REPORT_TITLE + "\n**Verdict**: `"),
        report["risk_level"],
        F.lit("` (ML Risk Score: `"),
        percent_text(p),
        F.lit("`)\n\n"),
        report["summary"],
        F.lit("\n\n**Structural Signals**\n"),
        bullets(report["structural_signals"], DEFAULT_SIGNAL),
        F.lit("\n\n**Typosquatting / Impersonation**\n"),
        F.when(F.coalesce(F.length(risk), F.lit(0)) > 0, risk).otherwise(F.lit(DEFAULT_RISK)),
        F.lit("\n\n**Defense Recommendations**\n"),
        bullets(report["recommendations"], DEFAULT_ADVICE),
        F.lit("\n"),
    )


def with_report(df: DataFrame, p: str = "p_phishing", columns: list[str] | None = None) -> DataFrame:
    """Add ``report`` (struct) and ``ai_analysis`` (markdown) to scored feature rows."""
    staged = df.withColumn("report", threat_report(F.col("prediction"), F.col(p), flagged(columns)))
    return staged.withColumn("ai_analysis", markdown(F.col("report"), F.col(p)))


def content_key(prediction: Column, columns: list[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON of (features, prediction), keys sorted.

    It leaves out URL and probability, so equal keys may hide different scores.
    """
    pairs = [F.concat(F.lit(f'"{c}": '), F.col(c).cast("string")) for c in sorted(columns or FEATURES)]
    text = F.concat(
        F.lit('{"f": {'), F.concat_ws(", ", *pairs), F.lit('}, "p": '), prediction.cast("string"), F.lit("}")
    )
    return F.sha2(text, 256)


def distinct_reports(
    df: DataFrame, order_by: list[str], p: str = "p_phishing", columns: list[str] | None = None
) -> DataFrame:
    """(key, n_scans, first, report, ai_analysis): one report per content key.

    The report is that of the first row in ``order_by``. Only what the text needs is
    aggregated, and the text is written once per key afterwards.
    """
    order = F.struct(*order_by)
    needed = F.struct(F.col("prediction"), F.col(p).alias("p"), flag_mask(columns).alias("mask"))
    firsts = df.groupBy(content_key(F.col("prediction"), columns).alias("key")).agg(
        F.count(F.lit(1)).alias("n_scans"), F.min(order).alias("first"), F.min_by(needed, order).alias("r")
    )
    signals = masked_names(F.col("r.mask"), columns)
    staged = firsts.withColumn("report", threat_report(F.col("r.prediction"), F.col("r.p"), signals))
    return staged.withColumn("ai_analysis", markdown(F.col("report"), F.col("r.p"))).drop("r")


def investigation(df: DataFrame, p: str = "phishing_probability", error: str = "") -> DataFrame:
    """Add the offline investigation: ``agentic``, ``report`` and ``tools_used``.

    ``label`` and ``p`` may be null for URLs that were not classified.
    """
    note = f"\n\n> Agent error: `{error}`" if error else ""
    text = F.concat(
        F.lit(INVESTIGATION_TITLE + "\n**ML verdict**: `"),
        F.upper(F.coalesce("label", F.lit("unknown"))),
        F.lit("` (phishing probability `"),
        percent_text(F.coalesce(p, F.lit(0.0))),
        F.lit("`).\n\n" + OFFLINE_NOTE + note),
    )
    return df.withColumns(
        {"agentic": F.lit(False), "report": text, "tools_used": F.array().cast("array<string>")}
    )


def analyst_prompt(url: Column, prediction: Column, p: Column, preamble: str = PROMPT_PREAMBLE) -> Column:
    """The analyst's prompt text for a scored row (no model is called)."""
    return F.concat(
        F.lit(preamble + "\n\nURL: "),
        url,
        F.lit("\nML classifier verdict: "),
        by_prediction(prediction, VERDICT_TEXT),
        F.lit("\nML phishing probability: "),
        percent_text(p, 2),
        F.lit("\nStructural features (1=safe, 0=suspicious, -1=phishing): "),
        features_json(),
    )


def history_verdict(prediction: Column) -> Column:
    """Verdict word of a logged scan; anything but 0 reads safe."""
    return F.coalesce(label_text(prediction), F.lit("safe"))
