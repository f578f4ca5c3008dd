"""The shared test tables seen as the inputs of URL-risk jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.operators.features import extract_features
from lurescope.sources.tables import read_table

PREFIX, AUTHORITY, REST = "^(https?://)", "^https?://([^/?#]*)", r"(?s)^https?://[^/?#]*(.*)$"


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", "url")


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, variant, url): every page URL in nineteen spellings."""
    url = F.col("url")
    prefix, netloc, rest = (F.regexp_extract(url, p, 1) for p in (PREFIX, AUTHORITY, REST))
    forms: dict[str, Column] = {
        "as_is": url,
        "user": F.concat(prefix, F.lit("user@"), netloc, rest),
        "address": F.concat(prefix, F.lit("127.0.0.1"), rest),
        "port": F.concat(prefix, netloc, F.lit(":8080"), rest),
        "short": F.concat(prefix, F.lit("bit.ly"), rest),
        "long": F.concat(url, F.lit("a" * 60)),
        "double_slash": F.concat(url, F.lit("//x")),
        "no_scheme": F.concat(netloc, rest),
        "token": F.concat(prefix, F.lit("login-https."), netloc, rest),
        "mail": F.concat(url, F.lit("?to=mailto:a@b")),
        "spaces": F.concat(F.lit(" \t"), url, F.lit("\n ")),
        "bad_port": F.concat(prefix, netloc, F.lit(":99999"), rest),
        "bad_address": F.concat(prefix, F.lit("[::1"), rest),
        "two_gaps": F.concat(prefix, F.lit("[1::2::3]"), rest),
        "quad_colon": F.concat(prefix, F.lit("[1.2.3.4:]"), rest),
        "mapped": F.concat(prefix, F.lit("[::ffff:1.2.3.4]:81"), rest),
        "zone": F.concat(prefix, F.lit("[fe80::1%25eth-0]"), rest),
        "look_alike": F.concat(prefix, F.lit("a\u2100"), netloc, rest),
        "blank": F.lit("   "),
    }
    pairs = [F.struct(F.lit(name).alias("variant"), form.alias("url")) for name, form in forms.items()]
    exploded = page_urls(spark, sf_dir).select("page_id", F.explode(F.array(*pairs)).alias("v"))
    return exploded.select("page_id", "v.variant", "v.url")


def page_features(spark: SparkSession, sf_dir: str, dns: DataFrame | None = None) -> DataFrame:
    return extract_features(page_urls(spark, sf_dir), "url", dns)


def dns_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, resolves, ip): hosts of the pages; those first seen on an odd page fail."""
    host = F.regexp_extract("url", AUTHORITY, 1)
    first = page_urls(spark, sf_dir).groupBy(host.alias("host")).agg(F.min("page_id").alias("p"))
    ip = F.concat(F.lit("10.0."), (F.col("p") % 256).cast("string"), F.lit(".1"))
    return first.select("host", (F.col("p") % 2 == 0).alias("resolves"), ip.alias("ip"))


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a scan log; hours as times give ties, errors carry unreadable JSON."""
    e = read_table(spark, sf_dir, "events")
    p = F.col("value") / (F.lit(100) + F.col("value"))
    code = F.when(F.col("value") > 100, -1).otherwise(1).cast("string")
    features = F.when(F.col("event_type") == "error", "not json").otherwise(
        F.concat(F.lit('{"URL_Length": '), code, F.lit(', "port": 1}'))
    )
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("http://site"), F.col("user_id").cast("string"), F.lit(".example.com/")).alias("url"),
        F.when(p > 0.5, 0).otherwise(1).alias("prediction"),
        p.alias("probability"),
        features.alias("features"),
        F.date_trunc("hour", "ts").alias("created_at"),
    )


def variant_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL variants as a scan log in page order; ports were called phishing."""
    return url_variants(spark, sf_dir).select(
        F.concat_ws("-", F.lpad(F.col("page_id").cast("string"), 12, "0"), "variant").alias("id"),
        "url",
        F.when(F.col("variant") == "port", 0).otherwise(1).alias("prediction"),
        F.timestamp_seconds(F.col("page_id")).alias("created_at"),
    )


def feedback_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as corrections; some labels are out of range, some predictions absent."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row"),
        F.concat(F.lit("http://site"), F.col("user_id").cast("string"), F.lit("-x.example.com/")).alias("url"),
        F.when(F.col("event_type") != "view", F.when(F.col("value") > 100, 0).otherwise(1)).alias("predicted_label"),
        (F.col("event_id") % 4).cast("int").alias("correct_label"),
        F.date_trunc("hour", "ts").alias("created_at"),
    )


def lineitem_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of lineitem; shipments before 2000 are the reference side."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp")).alias("is_ref"),
    )


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CODES = ["c_quantity", "c_discount", "c_tax", "c_flag", "c_status"]


def lineitem_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ternary codes of lineitem with gaps that follow from the row's own keys."""
    li = read_table(spark, sf_dir, "lineitem")

    def band(column: str, low: float, high: float) -> Column:
        return F.when(F.col(column) <= low, -1).when(F.col(column) <= high, 0).otherwise(1)

    codes = [
        band("l_quantity", 15, 35),
        band("l_discount", 0.03, 0.07),
        band("l_tax", 0.02, 0.05),
        F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1),
        F.when(F.col("l_linestatus") == "F", -1).otherwise(1),
    ]
    gap = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_suppkey")) % 23
    return li.select(
        *[F.when(gap != i, code.cast("double")).alias(name) for i, (name, code) in enumerate(zip(CODES, codes, strict=True))]
    )


RULES = {"short": 200, "medium": 800, "long": 3000}


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, label, short, medium, long): length rules as three classifiers."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rules = [F.when(F.col("n_chars") >= limit, 1).otherwise(0).alias(name) for name, limit in RULES.items()]
    return labels.join(docs, "doc_id").select("doc_id", "source", "label", *rules)


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL variants with features and a label: dashed or odd hosts are phishing, with
    hash noise on one URL in twenty."""
    rows = extract_features(url_variants(spark, sf_dir).withColumn("url", F.trim("url")))
    noise = F.conv(F.substring(F.md5(F.concat("variant", F.col("page_id").cast("string"))), 1, 4), 16, 10)
    bad = (F.col("Prefix_Suffix") == -1) | (F.col("having_IP_Address") == -1) | (F.col("port") == -1)
    flip = noise.cast("int") % 20 == 0
    return rows.withColumn("Result", F.when(bad != flip, -1).otherwise(1).cast("bigint"))
