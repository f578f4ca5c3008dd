"""URL parts and the 30 feature codes, as native column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurescope.contract import LURE_WORDS, PHISHING, SAFE, SHORTENERS, SUSPICIOUS

# Whitespace trimmed at intake, and text patterns of the URL parts.
TRIM_PATTERN = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"
NETLOC_PATTERN = r"^https?://([^/?#]*)"
DOTTED_QUAD = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_QUAD = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\]|%)|(?=\]|%))){4}"
# Eight groups, or up to seven around one ``::``; a dotted quad stands last and counts twice.
_FULL = rf"(?:{_GROUP}:){{6}}(?:{_GROUP}:{_GROUP}|{_QUAD})"
_SHORT = rf"(?!(?::*+[^:%\]]++){{8}})(?!(?::*+[^:%.\]]++){{6}}:*+[0-9]++\.)(?:{_GROUP}(?::{_GROUP})*)?::(?:(?:{_GROUP}:)*(?:{_GROUP}|{_QUAD}))?"
BRACKETED_ADDRESS = rf"(?s)^[^\[]*\[(?:(?:{_FULL}|{_SHORT})(?:%[^%\]]+)?|[vV][0-9A-Fa-f]+\.[^\]]+)\]"

#: Characters that compatibility normalisation turns into a delimiter of the authority part.
DELIMITER_LIKE = "".join(chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and set("/?#@:") & set(unicodedata.normalize("NFKC", chr(c))))


def trimmed(url: Column) -> Column:
    return F.regexp_replace(url, TRIM_PATTERN, "")


def normalised(url: Column) -> Column:
    """Prefix ``http://`` unless the text already starts with a web scheme."""
    has_scheme = url.startswith("http://") | url.startswith("https://")
    return F.when(has_scheme, url).otherwise(F.concat(F.lit("http://"), url))


def raw_netloc(u: Column) -> Column:
    """Authority part with user info and port; tabs and line breaks do not count."""
    return F.regexp_extract(F.regexp_replace(u, r"[\t\r\n]", ""), NETLOC_PATTERN, 1)


def bad_brackets(netloc: Column) -> Column:
    """True for an authority part that cannot be parsed: address literals, look-alikes of delimiters."""
    opens, closes = netloc.contains("["), netloc.contains("]")
    return (opens != closes) | (opens & closes & ~netloc.rlike(BRACKETED_ADDRESS)) | netloc.rlike(f"[{DELIMITER_LIKE}]")


def host_and_port(netloc: Column) -> Column:
    """Authority part behind the user info."""
    return F.regexp_extract(netloc, r"(?s)([^@]*)$", 1)


def port_text(netloc: Column) -> Column:
    info = host_and_port(netloc)
    bracketed = F.regexp_extract(info, r"(?s)^[^\[]*\[[^\]]*\][^:]*:(.*)$", 1)
    plain = F.regexp_extract(info, r"(?s)^[^:]*:(.*)$", 1)
    return F.when(info.contains("["), bracketed).otherwise(plain)


def port_number(text: Column) -> Column:
    """Port as a number; null when absent or unusable."""
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
    return F.when(number <= 65535, number).cast("int")


def hostname(url: Column) -> Column:
    """Lower-cased host without user info and port, ``''`` when there is none."""
    with_scheme = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    netloc = F.regexp_extract(
        F.regexp_replace(with_scheme, r"[\t\r\n]", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1
    )
    info = host_and_port(netloc)
    bracketed = F.regexp_extract(info, r"\[([^\]]*)\]", 1)
    return F.lower(F.when(info.contains("["), bracketed).otherwise(F.regexp_extract(info, r"^([^:]*)", 1)))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(PHISHING)).otherwise(F.lit(SAFE))


def any_token(text: Column, tokens: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in tokens])


def length_band(n: Column) -> Column:
    return F.when(n > 75, F.lit(PHISHING)).when(n >= 54, F.lit(SUSPICIOUS)).otherwise(F.lit(SAFE))


def subdomain_band(netloc: Column) -> Column:
    dots = F.length(netloc) - F.length(F.replace(netloc, F.lit("."), F.lit("")))
    extra = dots - F.when(netloc.startswith("www."), 1).otherwise(0)
    return F.when(extra <= 1, F.lit(SAFE)).when(extra == 2, F.lit(SUSPICIOUS)).otherwise(F.lit(PHISHING))


def text_codes(u: Column, netloc: Column, scheme: Column, port: Column) -> dict[str, Column]:
    """Codes that follow from the URL text alone (the constant ones are added later)."""
    dash = netloc.contains("-")
    subdomains = subdomain_band(netloc)
    size = length_band(F.length(u))
    odd_port = port.isNotNull() & ~port.isin(0, 80, 443)
    lure = any_token(F.lower(netloc), LURE_WORDS)
    return {
        "having_IP_Address": flag(netloc.rlike(DOTTED_QUAD)),
        "URL_Length": size,
        "Shortining_Service": flag(any_token(netloc, SHORTENERS)),
        "having_At_Symbol": flag(u.contains("@")),
        "double_slash_redirecting": flag(F.substring(u, 8, 2147483647).contains("//")),
        "Prefix_Suffix": flag(dash),
        "having_Sub_Domain": subdomains,
        "SSLfinal_State": flag(scheme != "https"),
        "Domain_registeration_length": flag(dash | (subdomains == PHISHING)),
        "port": flag(odd_port),
        "HTTPS_token": flag(netloc.contains("https")),
        "URL_of_Anchor": size,
        "Submitting_to_email": flag(u.contains("mailto:")),
        "Abnormal_URL": flag(F.length(netloc) == 0),
        "Redirect": F.when(F.length(u) > 100, F.lit(SUSPICIOUS)).otherwise(F.lit(SAFE)),
        "Statistical_report": flag(lure & dash),
    }
