"""Confidence bands, reports, keys, prompts and transcripts."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lurescope.contract import FEATURES
from lurescope.functions import reports
from lurescope.functions.stats import metric_tag, percent_text
from lurescope.functions.verdicts import with_verdict
from lurescope.operators import transcript
from lurescope.operators.classify import heuristic_classify
from lurescope.operators.features import extract_features
from lurescope.plans.jobs import investigate_urls, score_urls

BANDS = {
    0.95: ("HIGH", False, 0),
    0.52: ("LOW", True, 0),
    0.70: ("MEDIUM", False, 0),
    0.5: ("LOW", True, 1),
    0.6: ("LOW", True, 0),
    0.4: ("LOW", True, 1),
    0.75: ("HIGH", False, 0),
    0.25: ("HIGH", False, 1),
    0.92: ("HIGH", False, 0),
}


def test_confidence_and_verdict(spark):
    rows = with_verdict(spark.createDataFrame([(p,) for p in BANDS], "p_phishing double")).collect()
    for r in rows:
        level, review, code = BANDS[r["p_phishing"]]
        if r["p_phishing"] in (0.4, 0.6):  # the band edges follow double arithmetic
            level = "LOW" if abs(r["p_phishing"] - 0.5) < 0.10 else "MEDIUM"
            review = level == "LOW"
        assert (r["confidence"], r["needs_review"], r["prediction"]) == (level, review, code)
        assert r["label"] == ("phishing" if code == 0 else "safe")


def test_percentages_match_c_rounding(spark):
    rnd = random.Random(1)
    values = [i / 2000 for i in range(2001)] + [i / 64 for i in range(65)] + [rnd.random() for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    rows = df.select("p", percent_text(F.col("p")).alias("one"), percent_text(F.col("p"), 2).alias("two")).collect()
    for r in rows:
        assert r["one"] == f"{r['p'] * 100:.1f}%" and r["two"] == f"{r['p'] * 100:.2f}%"


def test_metric_tag(spark):
    assert spark.range(1).select(metric_tag(F.lit(0.9681234)).alias("t")).first()["t"] == "0.968123"


def test_report_of_flagged_features(spark):
    df = spark.createDataFrame([(0, 0.8, -1, -1, 1)], "prediction int, p double, having_IP_Address int, Prefix_Suffix int, SSLfinal_State int")
    row = reports.with_report(df, "p", ["having_IP_Address", "Prefix_Suffix", "SSLfinal_State"]).first()
    text = row["ai_analysis"]
    assert "L2 AI Threat Report" in text and "80.0%" in text and "* having_IP_Address\n* Prefix_Suffix" in text
    assert "`HIGH`" in text and row["report"]["structural_signals"] == ["having_IP_Address", "Prefix_Suffix"]


def test_markdown_defaults(spark):
    report = F.struct(
        F.lit("HIGH").alias("risk_level"),
        F.lit("Looks malicious.").alias("summary"),
        F.array().cast("array<string>").alias("structural_signals"),
        F.lit("").alias("typosquatting_risk"),
        F.array().cast("array<string>").alias("recommendations"),
    )
    text = spark.range(1).select(reports.markdown(report, F.lit(0.91)).alias("t")).first()["t"]
    assert "91.0%" in text and "* None detected." in text and "Not assessed." in text and "* Stay vigilant." in text


def test_safe_report_without_signals(spark):
    df = spark.createDataFrame([(1, 0.02, 1)], "prediction int, p double, port int")
    text = reports.with_report(df, "p", ["port"]).first()["ai_analysis"]
    assert reports.NO_SIGNALS in text and "`SAFE`" in text and "2.0%" in text


def test_content_key_is_canonical_json(spark):
    rows = extract_features(spark.createDataFrame([("http://a-b.c/x",)], "url string")).withColumn("prediction", F.lit(0))
    row = rows.withColumn("key", reports.content_key(F.col("prediction"))).first()
    payload = json.dumps({"p": 0, "f": {c: row[c] for c in FEATURES}}, sort_keys=True)
    assert row["key"] == hashlib.sha256(payload.encode()).hexdigest()


def test_dedup_keeps_the_first_report(spark):
    rows = extract_features(spark.createDataFrame([("http://a.c/x", 2), ("http://a.d/x", 1), ("https://a.d", 3)], "url string, id int"))
    rows = with_verdict(rows.withColumn("p_phishing", F.col("id") / 10))
    found = {r["n_scans"]: r for r in reports.distinct_reports(rows, ["id"]).collect()}
    assert set(found) == {1, 2} and found[2]["first"]["id"] == 1 and "10.0%" in found[2]["ai_analysis"]


def classify(df):
    return heuristic_classify(df, FEATURES)


def test_scoring_and_offline_investigation(spark):
    urls = spark.createDataFrame([("http://bad@1.2.3.4",), ("  ",)], "url string")
    scored, rejected = score_urls(urls, classify)
    assert scored.count() == 1 and rejected.count() == 1
    stub = lambda df: with_verdict(df.withColumn("p_phishing", F.lit(0.9)))
    row = investigate_urls(urls, stub, error="boom").first()
    assert row["agentic"] is False and "offline" in row["report"].lower() and row["tools_used"] == []
    assert row["label"] == "phishing" and "`PHISHING`" in row["report"] and "90.0%" in row["report"] and "boom" in row["report"]
    bare = investigate_urls(urls, None).first()
    assert "`UNKNOWN`" in bare["report"] and "0.0%" in bare["report"]


def test_transcripts_fold_in_order_and_in_parts(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(150)] + [(2, 0, "system", "s")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    parts = transcript.fold_transcripts(df).orderBy("conv_id", "part").collect()
    assert [(r["conv_id"], r["part"], r["n_lines"]) for r in parts] == [(1, 1, 64), (1, 2, 64), (1, 3, 22), (2, 1, 1)]
    whole = "".join(r["transcript"] for r in parts if r["conv_id"] == 1)
    assert whole == "".join(f"{'User' if t % 2 == 0 else 'Assistant'}: m{t}\n" for t in range(150))
    asked = spark.createDataFrame([(1, "why?"), (3, "new?")], "conv_id long, message string")
    prompt = transcript.chat_prompts(df, asked, "ctx").orderBy("conv_id", "part").collect()
    text = "".join(r["transcript"] for r in prompt if r["conv_id"] == 1)
    assert text == "ctx\n\n" + whole + "User: why?\nAssistant:"
    assert "".join(r["transcript"] for r in prompt if r["conv_id"] == 3) == "ctx\n\nUser: new?\nAssistant:"


@pytest.mark.parametrize("columns", [["port"], FEATURES])
def test_prompt_lists_the_verdict(spark, columns):
    rows = extract_features(spark.createDataFrame([("http://a.b",)], "url string"))
    rows = with_verdict(rows.withColumn("p_phishing", F.lit(0.98765)))
    text = rows.select(reports.analyst_prompt(F.col("url"), F.col("prediction"), F.col("p_phishing")).alias("t")).first()["t"]
    assert "URL: http://a.b\n" in text and "PHISHING / SUSPICIOUS" in text and "98.77%" in text
    assert all(f'"{c}":' in text for c in columns)
