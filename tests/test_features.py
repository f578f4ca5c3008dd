"""URL features, parts and intake checks on hand-picked URLs."""

import pytest

from lurescope.contract import DATASET_SCHEMA, FEATURES, TARGET
from lurescope.operators.features import assemble, extract_features, feature_array, features_from_json, features_json
from lurescope.operators.intake import check_feedback, split_intake
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def codes(spark):
    urls = [
        "http://127.0.0.1/login",
        "https://example.com",
        "http://legit.com@127.0.0.1/login",
        "http://example.com",
        "http://secure-paypal@127.0.0.1",
        "http://bit.ly/abcd",
        "example.com",
        "http://",
        "http://a.b:8443/",
        "http://a.b:0/",
        "http://a.b:443/",
        "HTTP://x",
        "ftp://x",
        "http://a_b.com/x",
        "http://café.fr/x",
        "https://microsoft.com",
        "http://[::1/x",
        "http://[::1]:8080/x",
        "http://a.com/http://b",
        "https:///x//y",
        "http://www.a.b.com/",
        "http://www.a.b.c.com/",
        "http://x.com/?a=mailto:me",
        "http://my-login.com",
        "http://login.com",
        "http://https.com",
        *["http://a.com/" + "x" * (n - 13) for n in (53, 54, 75, 76, 100, 101)],
    ]
    rows = extract_features(spark.createDataFrame([(u,) for u in urls], "url string"), keep_parts=True).collect()
    return {r["url"]: r for r in rows}


CASES = [
    ("http://127.0.0.1/login", "having_IP_Address", -1),
    ("https://example.com", "having_IP_Address", 1),
    ("https://example.com", "SSLfinal_State", 1),
    ("http://example.com", "SSLfinal_State", -1),
    ("http://legit.com@127.0.0.1/login", "having_At_Symbol", -1),
    ("http://legit.com@127.0.0.1/login", "having_IP_Address", 1),
    ("http://secure-paypal@127.0.0.1", "Prefix_Suffix", -1),
    ("http://secure-paypal@127.0.0.1", "Statistical_report", -1),
    ("http://secure-paypal@127.0.0.1", "Domain_registeration_length", -1),
    ("http://bit.ly/abcd", "Shortining_Service", -1),
    ("https://microsoft.com", "Shortining_Service", -1),
    ("http://", "Abnormal_URL", -1),
    ("http://a.b:8443/", "port", -1),
    ("http://a.b:0/", "port", 1),
    ("http://a.b:443/", "port", 1),
    ("http://[::1]:8080/x", "port", -1),
    ("http://a.com/http://b", "double_slash_redirecting", -1),
    ("https:///x//y", "Abnormal_URL", -1),
    ("http://www.a.b.com/", "having_Sub_Domain", 0),
    ("http://www.a.b.c.com/", "having_Sub_Domain", -1),
    ("http://x.com/?a=mailto:me", "Submitting_to_email", -1),
    ("http://my-login.com", "Statistical_report", -1),
    ("http://login.com", "Statistical_report", 1),
    ("http://https.com", "HTTPS_token", -1),
    ("http://[::1/x", "SSLfinal_State", -1),
]


@pytest.mark.parametrize("url,feature,code", CASES)
def test_code(codes, url, feature, code):
    assert codes[url][feature] == code


@pytest.mark.parametrize("n,length,redirect", [(53, 1, 1), (54, 0, 1), (75, 0, 1), (76, -1, 1), (100, -1, 1), (101, -1, 0)])
def test_length_bands(codes, n, length, redirect):
    row = codes["http://a.com/" + "x" * (n - 13)]
    assert (row["URL_Length"], row["URL_of_Anchor"], row["Redirect"]) == (length, length, redirect)


@pytest.mark.parametrize(
    "url,netloc",
    [
        ("example.com", "example.com"),
        ("HTTP://x", "HTTP:"),
        ("ftp://x", "ftp:"),
        ("http://a_b.com/x", "a_b.com"),
        ("http://café.fr/x", "café.fr"),
        ("http://[::1/x", "http://[::1/x"),
        ("http://", ""),
    ],
)
def test_authority(codes, url, netloc):
    assert codes[url]["netloc"] == netloc


def test_all_codes_are_ternary_and_complete(codes):
    assert len(FEATURES) == 30 and len(DATASET_SCHEMA) == 31 and DATASET_SCHEMA[-1].name == TARGET
    for row in codes.values():
        assert all(row[c] in (-1, 0, 1) for c in FEATURES)
    assert codes["example.com"]["u"] == "http://example.com"


def test_intake_trims_and_rejects(spark):
    urls = ["   ", "\t \n", " http://a.b \n", "http://a.b:abc/", "http://a.b:99999/", "http://a.b:1:2/", "http://[::1/x"]
    accepted, rejected = split_intake(spark.createDataFrame([(u,) for u in urls], "url string"))
    assert {r["url"] for r in accepted.collect()} == {"http://a.b", "http://[::1/x"}
    reasons = {r["url"]: r["reject_reason"] for r in rejected.collect()}
    assert reasons[""] == "empty_url" and reasons["http://a.b:abc/"] == "invalid_port"
    assert accepted.count() + rejected.count() == len(urls)


def test_dns_join_codes_and_defaults(spark):
    urls = spark.createDataFrame([("http://u@a.com/",), ("http://a.com/",), ("http://b.com/",)], "url string")
    dns = spark.createDataFrame([("a.com", True, "1.2.3.4"), ("b.com", False, None)], "host string, resolves boolean, ip string")
    found = {r["url"]: r["DNSRecord"] for r in extract_features(urls, dns=dns).collect()}
    # The authority keeps its user info, so the first URL has no snapshot entry.
    assert found == {"http://u@a.com/": -1, "http://a.com/": 1, "http://b.com/": -1}
    assert {r["DNSRecord"] for r in extract_features(urls).collect()} == {1}


def test_vectors_fill_missing_features_with_safe(spark):
    df = spark.createDataFrame([(-1, None)], "port int, Iframe int")
    values = feature_array(df).first()["feature_array"]
    assert len(values) == 30 and values[FEATURES.index("port")] == -1 and sum(values) == 28
    assert assemble(extract_features(spark.createDataFrame([("http://a.b",)], "url string"))).first()["vector"].size == 30


def test_json_codec_tolerates_bad_text(spark):
    rows = extract_features(spark.createDataFrame([("http://a-b.c",)], "url string"))
    text = rows.select(features_json().alias("f")).first()["f"]
    df = spark.createDataFrame([(text,), ("not json",), (None,)], "f string").select(features_from_json(F.col("f")).alias("m"))
    parsed = [r["m"] for r in df.collect()]
    assert parsed[0]["Prefix_Suffix"] == -1 and parsed[1] is None and parsed[2] is None


def test_feedback_labels(spark):
    df = spark.createDataFrame(
        [("u", 0, 1), ("u", 5, 1), ("u", 1, None), ("u", None, 1)], "url string, correct_label int, predicted_label int"
    )
    rows = [(r["correct_label"], r["predicted_label"], r["accepted"]) for r in check_feedback(df).collect()]
    assert rows == [(0, 1, True), (5, 1, False), (1, -1, True), (None, 1, False)]


def test_result_does_not_depend_on_partitioning(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    results = [sorted(map(tuple, extract_features(urls.repartition(n)).collect())) for n in (1, 7, 64)]
    assert results[0] == results[1] == results[2]


def test_filters_do_not_spell_out_the_parts_again(spark):
    """A row's parts, features and their JSON are computed once, whatever filters follow."""
    from lurescope.plans.jobs import feedback_rows
    from lurescope.sources.logs import prepare_feedback

    given = [("http://a-b.com:81/x", 0, 1), ("http://a.b:99999/", 1, 1), ("http://[::1/x", 0, 0), (None, 1, None), ("http://c.fr/", 1, 4)]
    source = spark.createDataFrame(given, "url string, correct_label int, predicted_label int").repartition(2)
    rows, rejects = prepare_feedback(source)
    contract = feedback_rows(rows)
    plan = contract._jdf.queryExecution().optimizedPlan().toJSON()
    assert 0 < plan.count("expressions.RLike") < 40
    assert [r["url"] for r in rejects.collect()] == ["http://a.b:99999/"]
    found = {(r["Prefix_Suffix"], r["port"], r["Abnormal_URL"], r["Result"]) for r in contract.collect()}
    assert (-1, -1, 1, -1) in found and contract.count() == 4
