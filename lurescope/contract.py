"""Dataset contract, log-table schemas and thresholds shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: the published dataset contract (spelling included) -------
FEATURES = [
    "having_IP_Address",
    "URL_Length",
    "Shortining_Service",
    "having_At_Symbol",
    "double_slash_redirecting",
    "Prefix_Suffix",
    "having_Sub_Domain",
    "SSLfinal_State",
    "Domain_registeration_length",
    "Favicon",
    "port",
    "HTTPS_token",
    "Request_URL",
    "URL_of_Anchor",
    "Links_in_tags",
    "SFH",
    "Submitting_to_email",
    "Abnormal_URL",
    "Redirect",
    "on_mouseover",
    "RightClick",
    "popUpWidnow",
    "Iframe",
    "age_of_domain",
    "DNSRecord",
    "web_traffic",
    "Page_Rank",
    "Google_Index",
    "Links_pointing_to_page",
    "Statistical_report",
]
TARGET = "Result"

# Features that the URL text alone cannot tell; they carry the safe code.
CONSTANT_FEATURES = [
    "Favicon",
    "Request_URL",
    "Links_in_tags",
    "SFH",
    "on_mouseover",
    "RightClick",
    "popUpWidnow",
    "Iframe",
    "age_of_domain",
    "web_traffic",
    "Page_Rank",
    "Google_Index",
    "Links_pointing_to_page",
]

SHORTENERS = [
    "bit.ly",
    "goo.gl",
    "shorte.st",
    "go2l.ink",
    "x.co",
    "ow.ly",
    "t.co",
    "tinyurl",
    "tr.im",
    "is.gd",
    "cli.gs",
]
LURE_WORDS = ["login", "verify", "secure", "update", "bank", "paypal", "signin", "support", "account"]

SAFE, SUSPICIOUS, PHISHING = 1, 0, -1

KS_THRESHOLD = 0.05
PSI_THRESHOLD = 0.2
DATASET_DRIFT_SHARE = 0.3
PSI_BUCKETS = 10
PSI_FLOOR = 1e-6

TEST_SHARE = 0.2
SPLIT_SEED = 42
NEIGHBOURS = 3
MIN_F1 = 0.6
OVERFIT_GAP = 0.05
MIN_IMPROVEMENT = 0.0

REVIEW_MARGIN = 0.10
MEDIUM_MARGIN = 0.25

SCAN_LIMIT = 50
RECENT_SCANS = 100
FEEDBACK_LIMIT = 100
RUN_LIMIT = 10
PAST_VERDICTS = 5
PRODUCTION_ALIAS = "production"
# --- end of fixed values ----------------------------------------------------

DATASET_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in [*FEATURES, TARGET]])

SCAN_LOG = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("prediction", T.IntegerType(), False),
        T.StructField("probability", T.DoubleType(), False),
        T.StructField("features", T.StringType(), False),
        T.StructField("ai_analysis", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
RUN_LOG = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("model_path", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
FEEDBACK_LOG = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("predicted_label", T.IntegerType()),
        T.StructField("correct_label", T.IntegerType(), False),
        T.StructField("features", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
MODEL_VERSIONS = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("run_id", T.StringType()),
        T.StructField("model_path", T.StringType()),
        T.StructField("input_schema", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
MODEL_ALIASES = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("alias", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("test_f1", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# JSON shape of a feature map: one integer code per contract feature.
FEATURE_STRUCT = T.StructType([T.StructField(c, T.IntegerType()) for c in FEATURES])
