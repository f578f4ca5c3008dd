"""URL column -> 30 contract features, feature vectors and flagged-feature lists."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.contract import CONSTANT_FEATURES, FEATURE_STRUCT, FEATURES, PHISHING, SAFE, SUSPICIOUS
from lurescope.functions import urls
from lurescope.operators.dns import with_dns_code

PARTS = ["u", "netloc", "scheme", "port_no", "parse_error"]


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns that later filters read instead of computing them again.

    They come out of a one-row generator. A filter on a plain projection is moved below it and brings the whole
    expressions along, spelled out once per mention: for features read back from JSON that is thousands of patterns a row.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    names = {name: f"_once_{name}" for name in columns}
    staged = df.select("*", F.inline(F.array(made)).alias(*names.values()))
    return staged.drop(*columns).withColumnsRenamed({v: k for k, v in names.items()})


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the normalised URL, its parts and ``parse_error``.

    ``invalid_ipv6``: the authority cannot be parsed, so the whole original text
    stands in for it and the row still gets its codes. ``invalid_port``: the URL
    cannot be scored; see :func:`lurescope.operators.intake.split_intake`.
    """
    staged = df.withColumn("u", urls.normalised(F.col(url))).withColumn("netloc", urls.raw_netloc(F.col("u")))
    bad = urls.bad_brackets(F.col("netloc"))
    staged = staged.withColumns({"_bad": bad, "_port": urls.port_text(F.col("netloc"))})
    number = urls.port_number(F.col("_port"))
    staged = staged.withColumn("_number", number)
    return computed_once(
        staged,
        scheme=F.when(F.col("_bad"), F.lit("")).when(F.col("u").startswith("https"), "https").otherwise("http"),
        port_no=F.when(~F.col("_bad"), F.col("_number")),
        parse_error=F.when(F.col("_bad"), "invalid_ipv6").when((F.col("_port") != "") & F.col("_number").isNull(), "invalid_port"),
        netloc=F.when(F.col("_bad"), F.col(url)).otherwise(F.col("netloc")),
    ).drop("_bad", "_port", "_number")


def extract_features(
    df: DataFrame, url: str = "url", dns: DataFrame | None = None, keep_parts: bool = False
) -> DataFrame:
    """Append the 30 feature columns in contract order.

    Without ``dns`` this is one map-only projection. With ``dns(host, resolves, ip)``
    the ``DNSRecord`` code comes from a left join on the authority part.
    """
    staged = with_url_parts(df, url)
    codes = urls.text_codes(*(F.col(c) for c in ["u", "netloc", "scheme", "port_no"]))
    codes.update({name: F.lit(SAFE) for name in CONSTANT_FEATURES})
    codes["DNSRecord"] = F.lit(SAFE)
    if dns is not None:
        staged = with_dns_code(staged, dns)
        codes["DNSRecord"] = F.col("dns_code")
    carried = [c for c in df.columns if c not in FEATURES]
    kept = carried + ([c for c in PARTS if c not in carried] if keep_parts else [])
    return staged.select(*kept, *[codes[name].alias(name) for name in FEATURES])


def feature_array(df: DataFrame, out: str = "feature_array") -> DataFrame:
    """Codes in contract order; a feature that is absent or null counts as safe."""
    have = set(df.columns)
    items = [F.coalesce(F.col(c).cast("int"), F.lit(SAFE)) if c in have else F.lit(SAFE) for c in FEATURES]
    return df.withColumn(out, F.array(*items))


def assemble(df: DataFrame, columns: list[str] | None = None, out: str = "vector") -> DataFrame:
    """MLlib vector of the features, in contract order."""
    columns = columns or FEATURES
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def flagged(columns: list[str] | None = None) -> Column:
    """Names of the features coded phishing or suspicious, in contract order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("code")) for c in columns or FEATURES])
    hits = F.filter(pairs, lambda x: x["code"].isin(PHISHING, SUSPICIOUS))
    return F.transform(hits, lambda x: x["name"])


def flag_mask(columns: list[str] | None = None) -> Column:
    """The flagged features of a row as bits, so that they aggregate as a number."""
    bits = [F.when(F.col(c) < SAFE, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns or FEATURES)]
    return sum((b.cast("bigint") for b in bits), F.lit(0).cast("bigint"))


def masked_names(mask: Column, columns: list[str] | None = None) -> Column:
    """Names of the bits set in a mask, in contract order."""
    names = F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, c) for i, c in enumerate(columns or FEATURES)])
    return F.filter(names, lambda x: x.isNotNull())


def features_json(columns: list[str] | None = None) -> Column:
    """The feature map of a row as JSON text, keys in contract order."""
    return F.to_json(F.struct(*[F.col(c) for c in columns or FEATURES]))


def features_from_json(text: Column) -> Column:
    """Feature struct of a JSON text; null when the text is not a feature map."""
    return F.when(F.get_json_object(text, "$").isNotNull(), F.from_json(text, FEATURE_STRUCT))
