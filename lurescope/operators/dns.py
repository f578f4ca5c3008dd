"""DNS snapshot joins: the snapshot table stands in for live resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.contract import PHISHING, SAFE
from lurescope.functions.urls import hostname
from lurescope.plans.skew import salted_left_join


def dns_dimension(dns: DataFrame, host: str) -> DataFrame:
    """One row per host: a host resolves when any snapshot row says so."""
    return dns.groupBy(F.col("host").alias(host)).agg(
        F.coalesce(F.max("resolves"), F.lit(False)).alias("dns_resolves"),
        F.max(F.when(F.col("resolves"), F.col("ip"))).alias("dns_ip"),
    )


def with_dns_code(df: DataFrame, dns: DataFrame) -> DataFrame:
    """Add ``dns_code``: safe when the authority part resolves, else phishing."""
    dimension = dns_dimension(dns, "netloc").select("netloc", "dns_resolves")
    joined = _left(df, dimension, "netloc", ["u"])
    resolves = F.coalesce(F.col("dns_resolves"), F.lit(False))
    return joined.withColumn("dns_code", F.when(resolves, F.lit(SAFE)).otherwise(F.lit(PHISHING))).drop("dns_resolves")


def lookup_dns(df: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    """Add ``dns_domain``, ``dns_resolves`` and ``dns_ip`` keyed by the host name."""
    keyed = df.withColumn("dns_domain", hostname(F.col(url)))
    joined = _left(keyed, dns_dimension(dns, "dns_domain"), "dns_domain", [url])
    return joined.withColumn("dns_resolves", F.coalesce(F.col("dns_resolves"), F.lit(False)))


def _left(left: DataFrame, right: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    # A stream cannot be sketched up front; its batches are small, so a plain join does.
    if left.isStreaming:
        return left.join(right, key, "left")
    return salted_left_join(left, right, key, spread_by)
