"""SQL for each registered query, to be run on the same Parquet tables."""

from __future__ import annotations

from lurescope.contract import FEATURES, LURE_WORDS, SHORTENERS
from lurescope.functions import reports
from lurescope.functions.stats import EXACT_CELLS
from lurescope.functions.urls import DOTTED_QUAD
from lurescope.operators.transcript import CHAT_PREAMBLE, TURNS_PER_PART
from lurescope.plans.inputs import CODES, MEASURES, RULES
from lurescope.sources.catalog import MODEL_NAME


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- URL features -----------------------------------------------------------


def _ipv6() -> str:
    """Every shape of an IPv6 literal written out, one alternative per number of groups before ``::``."""
    group = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    quad = f"{octet}\\.{octet}\\.{octet}\\.{octet}"
    shapes = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{quad}"]
    for before in range(8):
        head = f"(?:{group}(?::{group}){{{before - 1}}})" if before else ""
        room = 7 - before
        tails = [""] + ([f"{group}(?::{group}){{0,{room - 1}}}"] if room else []) + ([f"(?:{group}:){{0,{room - 2}}}{quad}"] if room >= 2 else [])
        shapes += [f"{head}::{t}" for t in tails]
    return "^(?:" + "|".join(f"(?:{x})" for x in shapes) + ")(?:%[^%]+)?$"


#: The literal between the first ``[`` and the next ``]``; characters that look like delimiters, by code point.
LITERAL = "split_part(substring(raw, strpos(raw, '[') + 1), ']', 1)"
LOOK_ALIKES = "".join(map(chr, (0x2047, 0x2048, 0x2049, 0x2100, 0x2101, 0x2105, 0x2106, 0x2A74, 0xFE13, 0xFE16, 0xFE55, 0xFE56, 0xFE5F, 0xFE6B, 0xFF03, 0xFF0F, 0xFF1A, 0xFF1F, 0xFF20)))

VARIANTS = f"""
parts AS (
  SELECT page_id, url, regexp_extract(url, '^(https?://)', 1) AS s,
         regexp_extract(url, '^https?://([^/?#]*)', 1) AS n,
         regexp_extract(url, '(?s)^https?://[^/?#]*(.*)$', 1) AS r
  FROM pages),
variants AS (
  SELECT page_id, 'as_is' AS variant, url FROM parts
  UNION ALL SELECT page_id, 'user', s || 'user@' || n || r FROM parts
  UNION ALL SELECT page_id, 'address', s || '127.0.0.1' || r FROM parts
  UNION ALL SELECT page_id, 'port', s || n || ':8080' || r FROM parts
  UNION ALL SELECT page_id, 'short', s || 'bit.ly' || r FROM parts
  UNION ALL SELECT page_id, 'long', url || repeat('a', 60) FROM parts
  UNION ALL SELECT page_id, 'double_slash', url || '//x' FROM parts
  UNION ALL SELECT page_id, 'no_scheme', n || r FROM parts
  UNION ALL SELECT page_id, 'token', s || 'login-https.' || n || r FROM parts
  UNION ALL SELECT page_id, 'mail', url || '?to=mailto:a@b' FROM parts
  UNION ALL SELECT page_id, 'spaces', ' ' || chr(9) || url || chr(10) || ' ' FROM parts
  UNION ALL SELECT page_id, 'bad_port', s || n || ':99999' || r FROM parts
  UNION ALL SELECT page_id, 'bad_address', s || '[::1' || r FROM parts
  UNION ALL SELECT page_id, 'two_gaps', s || '[1::2::3]' || r FROM parts
  UNION ALL SELECT page_id, 'quad_colon', s || '[1.2.3.4:]' || r FROM parts
  UNION ALL SELECT page_id, 'mapped', s || '[::ffff:1.2.3.4]:81' || r FROM parts
  UNION ALL SELECT page_id, 'zone', s || '[fe80::1%25eth-0]' || r FROM parts
  UNION ALL SELECT page_id, 'look_alike', s || 'a' || chr(8448) || n || r FROM parts
  UNION ALL SELECT page_id, 'blank', '   ' FROM parts)"""


def url_parts(source: str, dns: bool = False) -> str:
    """CTEs ``p1``…``coded`` over a table with ``url``: parts, then the 30 codes."""
    shortener = " OR ".join(f"contains(netloc, {text(t)})" for t in SHORTENERS)
    lure = " OR ".join(f"contains(lower(netloc), {text(t)})" for t in LURE_WORDS)
    extra = "(length(netloc) - length(replace(netloc, '.', '')) - CASE WHEN netloc LIKE 'www.%' THEN 1 ELSE 0 END)"

    def flag(condition: str) -> str:
        return f"CASE WHEN {condition} THEN -1 ELSE 1 END"

    band = "CASE WHEN length(u) > 75 THEN -1 WHEN length(u) >= 54 THEN 0 ELSE 1 END"
    codes = {c: "1" for c in FEATURES}
    codes |= {
        "having_IP_Address": flag(f"regexp_matches(netloc, {text(DOTTED_QUAD)})"),
        "URL_Length": band,
        "Shortining_Service": flag(shortener),
        "having_At_Symbol": flag("contains(u, '@')"),
        "double_slash_redirecting": flag("contains(substring(u, 8), '//')"),
        "Prefix_Suffix": flag("contains(netloc, '-')"),
        "having_Sub_Domain": f"CASE WHEN {extra} <= 1 THEN 1 WHEN {extra} = 2 THEN 0 ELSE -1 END",
        "SSLfinal_State": flag("scheme <> 'https'"),
        "Domain_registeration_length": flag(f"contains(netloc, '-') OR {extra} > 2"),
        "port": flag("port_no IS NOT NULL AND port_no NOT IN (0, 80, 443)"),
        "HTTPS_token": flag("contains(netloc, 'https')"),
        "URL_of_Anchor": band,
        "Submitting_to_email": flag("contains(u, 'mailto:')"),
        "Abnormal_URL": flag("length(netloc) = 0"),
        "Redirect": "CASE WHEN length(u) > 100 THEN 0 ELSE 1 END",
        "Statistical_report": flag(f"({lure}) AND contains(netloc, '-')"),
    }
    if dns:
        codes["DNSRecord"] = "CASE WHEN d.resolves THEN 1 ELSE -1 END"
    listed = ", ".join(f"{codes[c]} AS {c}" for c in FEATURES)
    join = "LEFT JOIN dns d ON d.host = p4.netloc" if dns else ""
    return f"""
p1 AS (
  SELECT *, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url
                 ELSE 'http://' || url END AS u FROM {source}),
p2 AS (
  SELECT *, regexp_extract(regexp_replace(u, '[\\t\\r\\n]', '', 'g'), '^https?://([^/?#]*)', 1) AS raw FROM p1),
p3 AS (
  SELECT *, (contains(raw, '[') <> contains(raw, ']'))
            OR (contains(raw, '[') AND contains(raw, ']') AND NOT regexp_matches({LITERAL}, {text(_ipv6())})
                AND NOT regexp_matches({LITERAL}, '(?s)^[vV][0-9A-Fa-f]+\\..+$')) OR regexp_matches(raw, '[{LOOK_ALIKES}]') AS bad,
         regexp_extract(raw, '(?s)([^@]*)$', 1) AS info FROM p2),
p35 AS (
  SELECT *, CASE WHEN contains(info, '[') THEN regexp_extract(info, '(?s)^[^\\[]*\\[[^\\]]*\\][^:]*:(.*)$', 1)
                 ELSE regexp_extract(info, '(?s)^[^:]*:(.*)$', 1) END AS ptext FROM p3),
p36 AS (
  SELECT *, CASE WHEN regexp_matches(ptext, '^[0-9]+$') AND try_cast(ptext AS BIGINT) <= 65535
                 THEN try_cast(ptext AS BIGINT) END AS pnum FROM p35),
p4 AS (
  SELECT * EXCLUDE (bad, raw, info, ptext, pnum),
         CASE WHEN bad THEN url ELSE raw END AS netloc,
         CASE WHEN bad THEN '' WHEN starts_with(u, 'https') THEN 'https' ELSE 'http' END AS scheme,
         CASE WHEN NOT bad THEN CAST(pnum AS INTEGER) END AS port_no,
         CASE WHEN bad THEN 'invalid_ipv6' WHEN ptext <> '' AND pnum IS NULL THEN 'invalid_port' END AS parse_error
  FROM p36),
coded AS (SELECT p4.*, {listed} FROM p4 {join})"""


ALL = ", ".join(FEATURES)
DNS = """
dns AS (
  SELECT host, p % 2 = 0 AS resolves, '10.0.' || (p % 256) || '.1' AS ip
  FROM (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, min(page_id) AS p FROM pages GROUP BY 1))"""
HITS = "(" + " + ".join(f"CASE WHEN {c} < 1 THEN 1 ELSE 0 END" for c in FEATURES) + ")"
SIGNALS = "list_filter([" + ", ".join(f"CASE WHEN {c} IN (-1, 0) THEN '{c}' END" for c in FEATURES) + "], lambda x: x IS NOT NULL)"
JSON = "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {c}" for c in FEATURES) + " || '}'"
PAGE_SCORES = f"""{url_parts('pages')},
scored AS (
  SELECT *, CAST({HITS} AS DOUBLE) / ({HITS} + 3) AS p_phishing,
         CASE WHEN CAST({HITS} AS DOUBLE) / ({HITS} + 3) > 0.5 THEN 0 ELSE 1 END AS prediction,
         {SIGNALS} AS signals FROM coded)"""
LABELLED = f"""{VARIANTS},
trimmed AS (SELECT page_id, variant, trim(url) AS url FROM variants),{url_parts('trimmed')},
labelled AS (
  SELECT *, CASE WHEN (Prefix_Suffix = -1 OR having_IP_Address = -1 OR port = -1)
                      <> (('0x' || substr(md5(variant || page_id), 1, 4))::UBIGINT % 20 = 0)
                 THEN -1 ELSE 1 END AS Result FROM coded)"""


def by_prediction(texts: dict) -> str:
    def value(t):
        return "[" + ", ".join(map(text, t)) + "]" if isinstance(t, list) else text(t)

    return f"CASE WHEN prediction = 0 THEN {value(texts[0])} ELSE {value(texts[1])} END"


PERCENT = "format('{:.1f}%', p_phishing * 100)"
_summary = reports.SUMMARY_FORMAT.split("%s")
MARKDOWN = f"""
  {text(reports.REPORT_TITLE)} || chr(10) || '**Verdict**: `' || {by_prediction(reports.RISK_LEVEL)}
  || '` (ML Risk Score: `' || {PERCENT} || '`)' || chr(10) || chr(10)
  || {text(_summary[0])} || {by_prediction(reports.VERDICT_TEXT)} || {text(_summary[1])} || {PERCENT} || {text(_summary[2])}
  || chr(10) || chr(10) || '**Structural Signals**' || chr(10)
  || CASE WHEN len(signals) > 0 THEN '* ' || array_to_string(signals, chr(10) || '* ') ELSE '* ' || {text(reports.NO_SIGNALS)} END
  || chr(10) || chr(10) || '**Typosquatting / Impersonation**' || chr(10) || {by_prediction(reports.BRAND_RISK)}
  || chr(10) || chr(10) || '**Defense Recommendations**' || chr(10)
  || '* ' || array_to_string({by_prediction(reports.ADVICE)}, chr(10) || '* ') || chr(10)"""
CONTENT_KEY = (
    "sha256('{\"f\": {' || " + " || ', ' || ".join(f"'\"{c}\": ' || {c}" for c in sorted(FEATURES))
    + " || '}, \"p\": ' || prediction || '}')"
)

# --- drift ------------------------------------------------------------------

LINEITEM_LONG = "sides AS (SELECT *, l_shipdate < TIMESTAMP '2000-01-01' AS is_ref FROM lineitem),\nlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, is_ref FROM sides" for c in MEASURES
) + ")"


def long_of(source: str, columns: list[str], is_ref: str) -> str:
    rows = [f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {is_ref} AS is_ref FROM {source}" for c in columns]
    return "long AS (" + " UNION ALL ".join(rows) + ")"


def ks_p(d: str = "ks_d") -> str:
    root = "sqrt(CAST(n_ref AS DOUBLE) * n_cur / (CAST(n_ref AS DOUBLE) + n_cur))"
    lam = f"({d} * ({root} + 0.12 + 0.11 / {root}))"
    series = (
        f"list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END)"
        f" * exp(-2.0 * j * j * {lam} * {lam})))"
    )
    return (
        f"CASE WHEN n_ref > 0 AND n_cur > 0 THEN CASE WHEN {lam} < 0.2 THEN 1.0 "
        f"ELSE least(greatest({series}, 0.0), 1.0) END END"
    )


KS = f"""
counts AS (
  SELECT feature, value, count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_cur
  FROM long WHERE value IS NOT NULL GROUP BY ALL),
running AS (
  SELECT feature, value, n_ref, n_cur,
         sum(n_ref) OVER w AS cum_ref, sum(n_cur) OVER w AS cum_cur,
         sum(n_ref) OVER (PARTITION BY feature) AS tot_ref, sum(n_cur) OVER (PARTITION BY feature) AS tot_cur
  FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks0 AS (
  SELECT feature, CAST(max(tot_ref) AS BIGINT) AS n_ref, CAST(max(tot_cur) AS BIGINT) AS n_cur,
         max(abs(CAST(cum_ref AS DOUBLE) / nullif(tot_ref, 0) - CAST(cum_cur AS DOUBLE) / nullif(tot_cur, 0))) AS ks_d
  FROM running GROUP BY feature),
ks AS (SELECT *, {ks_p()} AS ks_p FROM ks0)"""
# The lattice of exact p-values cell by cell, one diagonal a step.
KS_EXACT = f"""
small AS (
  SELECT feature, least(n_ref, n_cur) AS m, greatest(n_ref, n_cur) AS n, CAST(round(ks_d * n_ref * n_cur) AS BIGINT) AS far
  FROM ks0 WHERE n_ref > 0 AND n_cur > 0 AND n_ref * n_cur <= {EXACT_CELLS}),
lattice(feature, m, n, far, i, j, p) AS (
  SELECT feature, m, n, far, 0::BIGINT, 0::BIGINT, CASE WHEN far <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM small
  UNION ALL
  SELECT feature, m, n, far, x, y, CASE WHEN abs(x * m - y * n) >= far THEN 1.0::DOUBLE ELSE sum(p * CASE WHEN x > i THEN x ELSE y END / (x + y)) END
  FROM (SELECT l.*, i + di AS x, j + 1 - di AS y FROM lattice l CROSS JOIN (VALUES (0), (1)) AS step(di))
  WHERE x <= n AND y <= m GROUP BY feature, m, n, far, x, y),
exact AS (SELECT feature, p FROM lattice WHERE i = n AND j = m)"""
PSI = """
quant AS (
  SELECT feature, quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q
  FROM long WHERE is_ref AND value IS NOT NULL GROUP BY feature),
edges AS (SELECT feature, list_sort(list_distinct(q)) AS e FROM quant),
bins AS (
  SELECT feature, least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) AS bin,
         sum(n_ref) AS n_ref, sum(n_cur) AS n_cur
  FROM counts JOIN edges USING (feature)
  WHERE len(e) >= 3 AND value BETWEEN e[1] AND e[len(e)] GROUP BY ALL),
shares AS (
  SELECT feature, greatest(n_ref / greatest(sum(n_ref) OVER (PARTITION BY feature), 1), 1e-6) AS ep,
         greatest(n_cur / greatest(sum(n_cur) OVER (PARTITION BY feature), 1), 1e-6) AS ap FROM bins),
psi AS (SELECT feature, sum((ap - ep) * ln(ap / ep)) AS psi FROM shares GROUP BY feature)"""


def report(features: list[str]) -> str:
    listed = "features AS (SELECT unnest([" + ", ".join(map(text, features)) + "]) AS feature)"
    return f"""{listed},
report AS (
  SELECT feature, round(ks_p, 6) AS ks_p_value, round(coalesce(psi, 0.0), 6) AS psi,
         coalesce(ks_p < 0.05, false) OR coalesce(psi, 0.0) > 0.2 AS drifted
  FROM features LEFT JOIN ks USING (feature) LEFT JOIN psi USING (feature))"""


SUMMARY = """
SELECT count(*) AS n_features, CAST(sum(drifted::INT) AS BIGINT) AS n_drifted,
       round(sum(drifted::INT)::DOUBLE / count(*), 4) AS drift_share,
       sum(drifted::INT)::DOUBLE / count(*) >= 0.3 AS dataset_drift FROM report"""
URL_SIDES = f"{VARIANTS},{url_parts('variants')},{long_of('coded', FEATURES, chr(34) + 'scheme' + chr(34) + ' = ' + text('http'))}"

# --- metrics ----------------------------------------------------------------

RULE_ROWS = f"""
rules AS (
  SELECT doc_id, source, quality AS label, {", ".join(f"CASE WHEN n_chars >= {v} THEN 1 ELSE 0 END AS {k}" for k, v in RULES.items())}
  FROM labels JOIN documents USING (doc_id))"""


def rule_long(extra: str = "", source: str = "rules") -> str:
    rows = [f"SELECT '{m}' AS model, doc_id, label, {m} AS prediction{extra} FROM {source}" for m in RULES]
    return "preds AS (" + " UNION ALL ".join(rows) + ")"


def weighted(by: str, source: str = "preds") -> str:
    return f"""
conf AS (SELECT {by}, label, prediction, count(*) AS n FROM {source} GROUP BY ALL),
roles AS (
  SELECT {by}, label AS cls, n AS support, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM conf
  UNION ALL SELECT {by}, prediction, 0, n, 0 FROM conf),
cls AS (SELECT {by}, cls, sum(support)::DOUBLE AS s, sum(predicted)::DOUBLE AS p, sum(tp)::DOUBLE AS tp FROM roles GROUP BY ALL),
metrics AS (
  SELECT {by}, CAST(sum(s) AS BIGINT) AS n_rows, sum(tp) / sum(s) AS accuracy,
         sum(s * CASE WHEN p > 0 THEN tp / p ELSE 0 END) / sum(s) AS "precision",
         sum(s * CASE WHEN s > 0 THEN tp / s ELSE 0 END) / sum(s) AS recall,
         sum(s * 2 * tp / (s + p)) / sum(s) AS f1
  FROM cls GROUP BY {by})"""


CATALOG = f"""{RULE_ROWS},
preds AS (SELECT source, label, medium AS prediction FROM rules),{weighted("source")},
catalog AS (
  SELECT '{MODEL_NAME}' AS name, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS version,
         'run-' || source AS run_id, CASE WHEN n_rows % 2 = 0 THEN 'production' ELSE 'staging' END AS alias,
         format('{{:.6f}}', round(f1, 6)) AS test_f1, n_rows AS updated_at, round(f1, 6) AS f1 FROM metrics),
champion AS (
  SELECT name, version, test_f1, run_id FROM catalog WHERE alias = 'production'
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, version DESC) = 1)"""

# --- logs -------------------------------------------------------------------

SCAN_LOG = """
scans AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'http://site' || user_id || '.example.com/' AS url,
         CASE WHEN value / (100 + value) > 0.5 THEN 0 ELSE 1 END AS prediction, value / (100 + value) AS probability,
         CASE WHEN value > 100 THEN -1 ELSE 1 END AS code, event_type, date_trunc('hour', ts) AS created_at
  FROM events)"""
FEEDBACK = """
fb AS (
  SELECT event_id AS row, 'http://site' || user_id || '-x.example.com/' AS url,
         coalesce(CASE WHEN event_type <> 'view' THEN CASE WHEN value > 100 THEN 0 ELSE 1 END END, -1) AS predicted_label,
         CAST(event_id % 4 AS INTEGER) AS correct_label, date_trunc('hour', ts) AS created_at FROM events)"""
FEEDBACK_COUNTS = f"""WITH {FEEDBACK}
SELECT correct_label IN (0, 1) AS accepted, correct_label, predicted_label, count(*) AS n FROM fb GROUP BY ALL"""


def verdict_columns(p: str) -> str:
    gap = f"abs({p} - 0.5)"
    return f"""CASE WHEN {p} > 0.5 THEN 0 ELSE 1 END AS prediction,
       CASE WHEN {p} > 0.5 THEN 'phishing' ELSE 'safe' END AS label, round({p}, 4) AS phishing_probability,
       CASE WHEN {gap} < 0.10 THEN 'LOW' WHEN {gap} < 0.25 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
       {gap} < 0.10 AS needs_review"""


def history(source: str) -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, id DESC) AS rn FROM {source}),
summary AS (
  SELECT url, count(*) AS previous_scans,
         string_agg(CASE WHEN prediction = 0 THEN 'phishing' ELSE 'safe' END, ',' ORDER BY rn) FILTER (rn <= 5) AS past_verdicts
  FROM ranked GROUP BY url)"""



def split(source: str, key: str) -> str:
    order = f"md5(CAST({key} AS VARCHAR) || '42'), {key}"
    return f"row_number() OVER (ORDER BY {order}) <= ceil((SELECT count(*) FROM {source}) * 0.2)"


# --- imputation -------------------------------------------------------------

BANDS = [
    "CASE WHEN l_quantity <= 15 THEN -1 WHEN l_quantity <= 35 THEN 0 ELSE 1 END",
    "CASE WHEN l_discount <= 0.03 THEN -1 WHEN l_discount <= 0.07 THEN 0 ELSE 1 END",
    "CASE WHEN l_tax <= 0.02 THEN -1 WHEN l_tax <= 0.05 THEN 0 ELSE 1 END",
    "CASE WHEN l_returnflag = 'A' THEN -1 WHEN l_returnflag = 'N' THEN 0 ELSE 1 END",
    "CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END",
]
GAP = "(l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 23"
CODE_ROWS = "codes AS (SELECT " + ", ".join(
    f"CASE WHEN {GAP} <> {i} THEN CAST({band} AS DOUBLE) END AS {name}" for i, (name, band) in enumerate(zip(CODES, BANDS, strict=True))
) + " FROM lineitem)"
_both = [f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)" for c in CODES]
_shared = " + ".join(f"{b}::INT" for b in _both)
_squares = " + ".join(f"CASE WHEN {b} THEN (r.{c} - d.{c}) * (r.{c} - d.{c}) ELSE 0.0 END" for b, c in zip(_both, CODES, strict=True))
_donor_order = ", ".join(f"d.{c} NULLS FIRST" for c in CODES)


def _fill(i: int, c: str) -> str:
    keys = ", ".join(f"r.{k} AS r_{k}" for k in CODES)
    names = ", ".join(f"r_{k}" for k in CODES)
    part = ", ".join(f"r.{k}" for k in CODES)
    return f"""
near{i} AS (
  SELECT {keys}, d.{c} AS v, d.copies,
         coalesce(sum(d.copies) OVER (PARTITION BY {part}
           ORDER BY {len(CODES)}.0 * ({_squares}) / ({_shared}), {_donor_order}
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT DISTINCT * FROM codes WHERE {c} IS NULL) r JOIN donors d
    ON d.{c} IS NOT NULL AND ({_shared}) > 0),
fill{i} AS (
  SELECT {names}, sum(v * least(copies, 3 - before)) / sum(least(copies, 3 - before)) AS v
  FROM near{i} WHERE before < 3 GROUP BY {names})"""


def _knn() -> str:
    fills = ",".join(_fill(i, c) for i, c in enumerate(CODES))
    joins = " ".join(
        f"LEFT JOIN fill{i} ON " + " AND ".join(f"c.{k} IS NOT DISTINCT FROM fill{i}.r_{k}" for k in CODES)
        for i in range(len(CODES))
    )
    values = ", ".join(
        f"round(coalesce(c.{c}, fill{i}.v, (SELECT avg({c}) FROM codes)), 6) AS {c}" for i, c in enumerate(CODES)
    )
    return f"""WITH {CODE_ROWS},
donors AS (SELECT {", ".join(CODES)}, count(*) AS copies FROM codes GROUP BY ALL),{fills},
filled AS (SELECT {values}, c.copies FROM donors c {joins})
SELECT {", ".join(CODES)}, CAST(sum(copies) AS BIGINT) AS n FROM filled GROUP BY ALL"""


SCALE_PARAMS = f"""
params AS (
  SELECT feature, q[2] AS median, q[3] - q[1] AS iqr, CASE WHEN q[3] = q[1] THEN 1.0 ELSE q[3] - q[1] END AS scale
  FROM (SELECT feature, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM long GROUP BY feature))"""
LINEITEM_ALL = long_of("lineitem", MEASURES, "true")


def _scaled(c: str) -> str:
    p = f"FROM params WHERE feature = '{c}'"
    return f"round(({c} - (SELECT median {p})) / (SELECT scale {p}), 6) AS {c}"


SCANS_OUT = f"""WITH {PAGE_SCORES}
SELECT url, prediction, round(p_phishing, 6) AS probability, {JSON} AS features FROM scored"""

BOOSTING_ROUNDS = 50


def boosting(rounds: int = BOOSTING_ROUNDS) -> str:
    """CTEs up to ``stumps``: one chain of tables per round, over the distinct labelled rows.

    ``w`` are row weights, ``h`` their sums per (feature, value, label), ``g`` the gain of every threshold, ``s`` the
    round's stump. Gains within 1e-10 of the node's impurity are ties.
    """
    numbers = ", ".join(f"({i}, '{c}', CAST({c} AS DOUBLE))" for i, c in enumerate(FEATURES))
    steps = [
        f"""{LABELLED},
base AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY {ALL}, Result) AS id, {ALL}, CASE WHEN Result = -1 THEN 0 ELSE 1 END AS y, count(*) AS c
  FROM labelled GROUP BY {ALL}, Result),
long AS MATERIALIZED (SELECT id, y, u.f, u.feature, u.v FROM base, LATERAL (VALUES {numbers}) u(f, feature, v)),
w0 AS MATERIALIZED (SELECT id, CAST(c AS DOUBLE) AS w FROM base)"""
    ]
    for k in range(1, rounds + 1):
        alive = f"EXISTS (SELECT 1 FROM s{k - 1} WHERE error < 0.5 AND error > 1e-15)" if k > 1 else "true"
        steps.append(f"""
h{k} AS MATERIALIZED (
  SELECT f, feature, v, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS a, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS b
  FROM long JOIN w{k - 1} USING (id) GROUP BY f, feature, v),
r{k} AS (
  SELECT f, feature, v, lead(v) OVER o AS after, sum(a) OVER o AS l0, sum(b) OVER o AS l1,
         sum(a) OVER (PARTITION BY f) AS t0, sum(b) OVER (PARTITION BY f) AS t1
  FROM h{k} WINDOW o AS (PARTITION BY f ORDER BY v)),
g{k} AS MATERIALIZED (
  SELECT *, 2 * (t0 * t1 / (t0 + t1) - CASE WHEN after IS NULL THEN t0 * t1 / (t0 + t1) ELSE l0 * l1 / (l0 + l1)
         + (t0 - l0) * (t1 - l1) / (t0 - l0 + t1 - l1) END) AS gain FROM r{k}),
b{k} AS (
  SELECT *, gain > 1e-12 * (t0 + t1) AS splits FROM g{k}
  WHERE gain >= (SELECT max(gain) - 1e-10 * max(2 * t0 * t1 / (t0 + t1)) FROM g{k}) ORDER BY f, v LIMIT 1),
c{k} AS (
  SELECT CASE WHEN splits THEN feature ELSE '{FEATURES[0]}' END AS feature, CASE WHEN splits THEN (v + after) / 2 ELSE 0 END AS threshold,
         CASE WHEN (splits AND l1 > l0) OR (NOT splits AND t1 > t0) THEN 1 ELSE 0 END AS "left",
         CASE WHEN (splits AND t1 - l1 > t0 - l0) OR (NOT splits AND t1 > t0) THEN 1 ELSE 0 END AS "right",
         CASE WHEN splits THEN least(l0, l1) + least(t0 - l0, t1 - l1) ELSE least(t0, t1) END / (t0 + t1) AS error, t0 + t1 AS total
  FROM b{k}),
s{k} AS MATERIALIZED (
  SELECT {k - 1} AS round, *, CASE WHEN error <= 1e-15 THEN 1.0 ELSE ln((1 - error) / error) END AS alpha FROM c{k} WHERE error < 0.5 AND {alive}),
w{k} AS MATERIALIZED (
  SELECT id, w / total * CASE WHEN CASE WHEN v <= threshold THEN "left" ELSE "right" END <> y THEN exp(alpha) ELSE 1 END AS w
  FROM w{k - 1} JOIN long USING (id) JOIN s{k} USING (feature))""")
    steps.append("\nstumps AS (" + " UNION ALL ".join(f"SELECT round, feature, threshold, \"left\", \"right\", alpha FROM s{k}" for k in range(1, rounds + 1)) + ")")
    return ",".join(steps)


ORACLE = {
    "adaboost_rounds": f"""WITH {boosting()}
SELECT CAST(round AS INTEGER) AS round, feature, round(threshold, 6) AS threshold, CAST("left" AS INTEGER) AS "left",
       CAST("right" AS INTEGER) AS "right", round(alpha, 6) AS alpha FROM stumps""",
    "model_scores": f"""WITH {boosting()},
pages_coded AS (SELECT * FROM (WITH {url_parts('pages')} SELECT page_id, {ALL} FROM coded)),
pages_long AS (SELECT page_id, u.feature, u.v FROM pages_coded, LATERAL (VALUES {", ".join(f"('{c}', CAST({c} AS DOUBLE))" for c in FEATURES)}) u(feature, v)),
margins AS (
  SELECT page_id, sum(CASE WHEN CASE WHEN v <= threshold THEN "left" ELSE "right" END = 1 THEN alpha ELSE -alpha END) / sum(alpha) AS m
  FROM pages_long JOIN stumps USING (feature) GROUP BY page_id),
scored AS (SELECT page_id, 1 - 1 / (1 + exp(-2 * m)) AS p_phishing FROM margins)
SELECT page_id, {verdict_columns('p_phishing')} FROM scored""",
    "url_features": f"WITH {url_parts('pages')} SELECT page_id, url, {ALL} FROM coded",
    "url_features_mutated": f"WITH {VARIANTS},{url_parts('variants')} SELECT page_id, variant, {ALL} FROM coded",
    "url_flag_summary": f"""WITH {VARIANTS},{url_parts('variants')},
hits AS (SELECT *, {" + ".join(f"({c} = -1)::INT" for c in FEATURES)} AS k, {HITS} AS h FROM coded)
SELECT netloc, count(*) AS n_urls, CAST(sum(k) AS BIGINT) AS n_phishing_codes, CAST(sum(h) AS BIGINT) AS n_flagged,
       array_to_string(list_filter([{", ".join(f"CASE WHEN bool_or({c} < 1) THEN '{c}' END" for c in FEATURES)}],
                                   lambda x: x IS NOT NULL), ',') AS signals
FROM hits GROUP BY netloc ORDER BY n_phishing_codes DESC, netloc LIMIT 20""",
    "flagged_signals": f"""WITH {url_parts('pages')}
SELECT page_id, array_to_string({SIGNALS}, ',') AS signals FROM coded""",
    "url_parts": f"""WITH {VARIANTS},{url_parts('variants')}
SELECT page_id, variant, u, netloc, scheme, port_no, parse_error FROM coded""",
    "url_intake_rejects": f"""WITH {VARIANTS},
clean AS (SELECT page_id, variant, regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS url FROM variants),{url_parts('clean')}
SELECT page_id, variant, url, CASE WHEN length(url) = 0 THEN 'empty_url' ELSE 'invalid_port' END AS reject_reason
FROM coded WHERE length(url) = 0 OR parse_error = 'invalid_port'""",
    "feature_vector": f"""WITH {url_parts('pages')}
SELECT page_id, {" || ',' || ".join("'1'" if c == "URL_Length" else c for c in FEATURES)} AS vector_text FROM coded""",
    "dns_enrich": f"""WITH {VARIANTS},{DNS},{url_parts('variants', dns=True)},
hosts AS (
  SELECT page_id, variant, DNSRecord, regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END,
    '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS n FROM coded),
keyed AS (
  SELECT page_id, variant, DNSRecord, regexp_extract(n, '([^@]*)$', 1) AS i FROM hosts),
named AS (
  SELECT page_id, variant, DNSRecord, lower(CASE WHEN contains(i, '[') THEN regexp_extract(i, '\\[([^\\]]*)\\]', 1)
    ELSE regexp_extract(i, '^([^:]*)', 1) END) AS dns_domain FROM keyed)
SELECT page_id, variant, DNSRecord, dns_domain, coalesce(resolves, false) AS dns_resolves,
       CASE WHEN resolves THEN ip END AS dns_ip
FROM named LEFT JOIN dns ON dns.host = dns_domain""",
    "drift_ks_small": f"""WITH RECURSIVE long AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS feature, CAST(s_acctbal AS DOUBLE) AS value, true AS is_ref FROM supplier
  UNION ALL SELECT CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS DOUBLE), false FROM customer),{KS},{KS_EXACT}
SELECT feature, n_ref, n_cur, round(ks_d, 6) AS ks_d, round(coalesce(exact.p, ks_p), 6) AS ks_p FROM ks LEFT JOIN exact USING (feature)""",
    "drift_ks": f"WITH {LINEITEM_LONG},{KS} SELECT feature, n_ref, n_cur, round(ks_d, 6) AS ks_d, round(ks_p, 6) AS ks_p FROM ks",
    "drift_psi": f"WITH {LINEITEM_LONG},{KS},{PSI},{report(MEASURES)} SELECT feature, psi FROM report",
    "histogram_counts": f"""WITH {LINEITEM_LONG},{KS},{PSI}
SELECT feature, CAST(bin AS INTEGER) AS bin, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur FROM bins""",
    "column_quantiles": f"""WITH {LINEITEM_LONG},{KS},{PSI}
SELECT feature, CAST(i - 1 AS INTEGER) AS decile, round(q[i], 6) AS value FROM quant, range(1, 12) t(i)""",
    "drift_report": f"WITH {LINEITEM_LONG},{KS},{PSI},{report(MEASURES)} SELECT * FROM report",
    "drift_summary": f"WITH {LINEITEM_LONG},{KS},{PSI},{report(MEASURES)} {SUMMARY}",
    "url_feature_drift": f"WITH {URL_SIDES},{KS},{PSI},{report(FEATURES)} SELECT * FROM report",
    "url_drift_summary": f"WITH {URL_SIDES},{KS},{PSI},{report(FEATURES)} {SUMMARY}",
    "validation_drift": f"""WITH {LABELLED},{long_of('labelled', [*FEATURES, 'Result'], 'SSLfinal_State = -1')},{KS}
SELECT feature AS column_name, round(ks_p, 6) AS p_value, coalesce(ks_p < 0.05, false) AS drift_status FROM ks""",
    "validation_verdict": f"""WITH {LABELLED},{long_of('labelled', [*FEATURES, 'Result'], 'SSLfinal_State = -1')},{KS}
SELECT NOT coalesce(bool_or(ks_p < 0.05), false) AS drift_free FROM ks""",
    "contract_check": f"""WITH {LABELLED}
SELECT CASE WHEN SSLfinal_State = -1 THEN 'train' ELSE 'test' END AS split, 31 AS expected_columns,
       CASE WHEN SSLfinal_State = -1 THEN 31 ELSE 30 END AS actual_columns, SSLfinal_State = -1 AS ok, false AS dataset_ok,
       count(*) AS n, 'invalid' AS kind FROM labelled GROUP BY SSLfinal_State""",
    "seeded_split": f"SELECT o_orderkey, {split('orders', 'o_orderkey')} AS is_test FROM orders",
    "split_counts": f"""WITH s AS (SELECT page_id, {split('pages', 'page_id')} AS is_test FROM pages)
SELECT is_test, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS id_sum FROM s GROUP BY is_test""",
    "label_remap": "SELECT doc_id, CASE WHEN quality * 2 - 1 = -1 THEN 0 ELSE quality * 2 - 1 END AS Result FROM labels",
    "column_means": f"WITH {CODE_ROWS} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in CODES)} FROM codes",
    "knn_impute": _knn(),
    "robust_scale_params": f"""WITH {LINEITEM_ALL},{SCALE_PARAMS}
SELECT feature, round(median, 6) AS median, round(iqr, 6) AS iqr, round(scale, 6) AS scale FROM params""",
    "robust_scale": f"""WITH {LINEITEM_ALL},{SCALE_PARAMS}
SELECT l_orderkey, l_linenumber, {", ".join(_scaled(c) for c in MEASURES)} FROM lineitem""",
    "distinct_row_folds": f"""WITH {LABELLED}
SELECT CAST(Result AS DOUBLE) AS label, count(*) AS n_rows FROM labelled GROUP BY 1""",
    "weighted_metrics": f"""WITH {RULE_ROWS},{rule_long()},{weighted("model")}
SELECT model, n_rows, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM metrics""",
    "best_model": f"""WITH {RULE_ROWS},
splits AS (SELECT *, {split('rules', 'doc_id')} AS is_test FROM rules),
{rule_long(", is_test", "splits")},{weighted("model, is_test")},
rep AS (
  SELECT model, CAST(list_position([{", ".join(map(text, RULES))}], model) - 1 AS INTEGER) AS ordinal,
         round(max(f1) FILTER (NOT is_test), 6) AS train_f1, round(max(f1) FILTER (is_test), 6) AS test_f1
  FROM metrics GROUP BY model)
SELECT *, test_f1 >= 0.6 AS meets_minimum, abs(train_f1 - test_f1) > 0.05 AS overfit
FROM rep ORDER BY test_f1 DESC, ordinal LIMIT 1""",
    "champion_gate": f"""WITH {RULE_ROWS},{rule_long()},{weighted("model")},
pair AS (SELECT max(f1) FILTER (model = 'short') AS a, max(f1) FILTER (model = 'medium') AS b FROM metrics)
SELECT a - b >= 0 AS accepted, round(a, 6) AS candidate_f1, round(b, 6) AS champion_f1,
       round(a - b, 6) AS improvement, CASE WHEN a - b >= 0 THEN '7' END AS promoted_version FROM pair""",
    "first_champion_gate": f"""WITH {RULE_ROWS},{rule_long()},{weighted("model")}
SELECT true AS accepted, round(f1, 6) AS candidate_f1, CAST(-1.0 AS DOUBLE) AS champion_f1, round(f1, 6) AS improvement,
       '1' AS promoted_version FROM metrics WHERE model = 'medium'""",
    "champion_lookup": f"WITH {CATALOG} SELECT name, version, test_f1, run_id FROM champion",
    "latest_version": f"WITH {CATALOG} SELECT name, max(version) AS version FROM catalog GROUP BY name",
    "stored_metric_gate": f"""WITH {CATALOG}
SELECT version, f1 AS test_f1, coalesce(f1 >= (SELECT CAST(test_f1 AS DOUBLE) FROM champion), true) AS promote FROM catalog""",
    "verdicts": f"WITH {SCAN_LOG} SELECT id, {verdict_columns('probability')} FROM scans",
    "confidence_bands": f"""WITH {SCAN_LOG}, v AS (SELECT {verdict_columns('probability')} FROM scans)
SELECT confidence, needs_review, label, count(*) AS n FROM v GROUP BY ALL""",
    "scan_history_topk": f"""WITH {SCAN_LOG}
SELECT id, url, prediction, round(probability, 6) AS probability,
       CASE WHEN event_type = 'error' THEN 'not json' ELSE '{{"URL_Length": ' || code || ', "port": 1}}' END AS features,
       CASE WHEN event_type <> 'error' THEN code END AS url_length_code, created_at
FROM scans ORDER BY created_at DESC, id DESC LIMIT 50""",
    "history_for_url": f"""WITH {SCAN_LOG},
newest AS (SELECT * FROM scans ORDER BY created_at DESC, id DESC LIMIT 100),
busiest AS (SELECT url FROM newest GROUP BY url ORDER BY count(*) DESC, url LIMIT 1)
SELECT id, url, prediction, created_at FROM newest WHERE url = (SELECT url FROM busiest)""",
    "history_summary": f"WITH {SCAN_LOG},{history('scans')} SELECT url, previous_scans, past_verdicts FROM summary",
    "stream_history": f"WITH {SCAN_LOG},{history('scans')} SELECT url, previous_scans, past_verdicts FROM summary",
    "history_enrich": f"""WITH {SCAN_LOG},{history('scans')},
users AS (SELECT c_custkey, 'http://site' || c_custkey || '.example.com/' AS url FROM customer)
SELECT c_custkey, url, coalesce(previous_scans, 0) AS previous_scans, coalesce(past_verdicts, '') AS past_verdicts
FROM users LEFT JOIN summary USING (url)""",
    "feedback_intake": FEEDBACK_COUNTS,
    "feedback_log": f"""WITH {FEEDBACK}, valid AS (SELECT * FROM fb WHERE correct_label IN (0, 1)),{url_parts('valid')}
SELECT row, url, predicted_label, correct_label, {JSON} AS features FROM coded""",
    "feedback_history": f"""WITH {FEEDBACK}
SELECT lpad(CAST(row AS VARCHAR), 12, '0') AS id, url, predicted_label, correct_label, created_at FROM fb
WHERE correct_label IN (0, 1) ORDER BY created_at DESC, id DESC LIMIT 100""",
    "feedback_training_rows": f"""WITH {FEEDBACK}, valid AS (SELECT * FROM fb WHERE correct_label IN (0, 1)),{url_parts('valid')}
SELECT {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in FEATURES)},
       CAST(CASE WHEN correct_label = 0 THEN -1 ELSE 1 END AS BIGINT) AS Result, count(*) AS n FROM coded GROUP BY ALL""",
    "report_markdown": f"WITH {PAGE_SCORES} SELECT page_id, {MARKDOWN} AS ai_analysis FROM scored",
    "report_dedup": f"""WITH {VARIANTS},{PAGE_SCORES.replace("FROM pages", "FROM variants")},
keyed AS (SELECT page_id, variant, {CONTENT_KEY} AS key, {MARKDOWN} AS ai_analysis FROM scored)
SELECT key, count(*) AS n_scans, arg_min(page_id, (page_id, variant)) AS first_page,
       arg_min(ai_analysis, (page_id, variant)) AS ai_analysis FROM keyed GROUP BY key""",
    "prompt_dataset": f"""WITH {PAGE_SCORES}
SELECT page_id, {text(reports.PROMPT_PREAMBLE)} || chr(10) || chr(10) || 'URL: ' || url || chr(10)
       || 'ML classifier verdict: ' || {by_prediction(reports.VERDICT_TEXT)} || chr(10)
       || 'ML phishing probability: ' || format('{{:.2f}}%', p_phishing * 100) || chr(10)
       || 'Structural features (1=safe, 0=suspicious, -1=phishing): ' || {JSON} AS prompt FROM scored""",
    "investigation_report": f"""WITH {DNS},{VARIANTS},
scans AS (
  SELECT lpad(CAST(page_id AS VARCHAR), 12, '0') || '-' || variant AS id, url,
         CASE WHEN variant = 'port' THEN 0 ELSE 1 END AS prediction, page_id AS created_at FROM variants),
{history('scans')},{url_parts('pages', dns=True)},
scored AS (
  SELECT page_id, url, round(CAST({HITS} AS DOUBLE) / ({HITS} + 3), 4) AS p_phishing,
         CAST({HITS} AS DOUBLE) / ({HITS} + 3) > 0.5 AS bad, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS dns_domain
  FROM coded)
SELECT page_id, dns_domain, coalesce(resolves, false) AS dns_resolves, CASE WHEN resolves THEN ip END AS dns_ip,
       coalesce(previous_scans, 0) AS previous_scans, coalesce(past_verdicts, '') AS past_verdicts, false AS agentic,
       {text(reports.INVESTIGATION_TITLE)} || chr(10) || '**ML verdict**: `' || CASE WHEN bad THEN 'PHISHING' ELSE 'SAFE' END
       || '` (phishing probability `' || {PERCENT} || '`).' || chr(10) || chr(10) || {text(reports.OFFLINE_NOTE)} AS report
FROM scored LEFT JOIN dns ON host = dns_domain LEFT JOIN summary USING (url)""",
    "stream_enrich": f"""WITH {DNS},{VARIANTS},
scans AS (
  SELECT lpad(CAST(page_id AS VARCHAR), 12, '0') || '-' || variant AS id, url,
         CASE WHEN variant = 'port' THEN 0 ELSE 1 END AS prediction, page_id AS created_at FROM variants),
{history('scans')},{url_parts('pages', dns=True)}
SELECT page_id, DNSRecord, coalesce(dns.resolves, false) AS dns_resolves,
       coalesce(previous_scans, 0) AS previous_scans, coalesce(past_verdicts, '') AS past_verdicts
FROM coded LEFT JOIN dns ON host = lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) LEFT JOIN summary USING (url)""",
    "transcript_parts": f"""
SELECT conv_id, CAST(turn // {TURNS_PER_PART} + 1 AS BIGINT) AS part, count(*) AS n_lines,
       string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) || chr(10) AS transcript
FROM conversations GROUP BY 1, 2""",
    "chat_prompts": f"""WITH asked AS (
  SELECT conv_id, max(turn) AS last, arg_max(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY 1),
earlier AS (SELECT c.* FROM conversations c JOIN asked a ON a.conv_id = c.conv_id AND c.turn < a.last)
SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS n_lines, {text(CHAT_PREAMBLE)} || chr(10) || chr(10) AS transcript FROM asked
UNION ALL
SELECT conv_id, turn // {TURNS_PER_PART} + 1, count(*),
       string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) || chr(10)
FROM earlier GROUP BY 1, 2
UNION ALL
SELECT conv_id, coalesce((SELECT max(turn) // {TURNS_PER_PART} + 2 FROM earlier e WHERE e.conv_id = asked.conv_id), 1), 1,
       'User: ' || message || chr(10) || 'Assistant:' FROM asked""",
    "scan_log_roundtrip": SCANS_OUT,
    "log_compaction_roundtrip": SCANS_OUT,
    "catalog_roundtrip": f"""WITH {RULE_ROWS}, preds AS (SELECT 'all' AS g, label, medium AS prediction FROM rules),{weighted("g")}
SELECT {text(MODEL_NAME)} AS name, 2 AS version, printf('%.6f', round(f1, 6)) AS test_f1, 'run-1' AS run_id FROM metrics""",
    "feature_store_roundtrip": f"""WITH {LABELLED}, t AS (SELECT count(*) AS n FROM labelled)
SELECT 'test' AS split, CAST(ceil(n * 0.2) AS BIGINT) AS n, 'valid' AS kind FROM t
UNION ALL SELECT 'train', CAST(n - ceil(n * 0.2) AS BIGINT), 'valid' FROM t""",
    "run_history": f"""WITH {RULE_ROWS}, preds AS (SELECT source, label, medium AS prediction FROM rules),{weighted("source")}
SELECT source AS id, 'run-' || source AS run_id, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1_score,
       TIMESTAMP '1970-01-01' + to_seconds(1700000000 + n_rows) AS created_at
FROM metrics ORDER BY created_at DESC, id DESC LIMIT 10""",
    "stream_scan_parity": SCANS_OUT,
    "stream_feedback": FEEDBACK_COUNTS,
    "stream_drift": f"""WITH banded AS (
  SELECT CASE WHEN value > 100 THEN -1 WHEN value > 30 THEN 0 ELSE 1 END AS value_band,
         hour(ts) % 3 - 1 AS hour_band, event_type FROM events),
long AS (
  SELECT 'value_band' AS feature, CAST(value_band AS DOUBLE) AS value, false AS is_ref FROM banded
  UNION ALL SELECT 'hour_band', CAST(hour_band AS DOUBLE), false FROM banded
  UNION ALL SELECT 'value_band', CAST(value_band AS DOUBLE), true FROM banded WHERE event_type = 'purchase'
  UNION ALL SELECT 'hour_band', CAST(hour_band AS DOUBLE), true FROM banded WHERE event_type = 'purchase'),
{KS},{PSI},{report(["value_band", "hour_band"])} SELECT * FROM report""",
    "stream_event_days": """WITH span AS (SELECT min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events),
placed AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, epoch_ms(ts) AS ms, value, event_id % 10 AS turn,
         CAST(floor(date_diff('day', first, CAST(ts AS DATE)) * 4 / (date_diff('day', first, last) + 1)) AS INT) AS quarter
  FROM events, span),
arrived AS (SELECT *, CASE turn WHEN 3 THEN quarter + 1 WHEN 7 THEN 4 ELSE quarter END AS arrival FROM placed),
newest AS (SELECT arrival, max(ms) AS ms FROM arrived GROUP BY 1),
marks AS (
  SELECT arrival, max(ms) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5 * 86400000 AS mark FROM newest),
judged AS (
  SELECT day, value, coalesce(epoch_ms(CAST(CAST(day AS DATE) + 1 AS TIMESTAMP)) <= mark, false) AS late FROM arrived JOIN marks USING (arrival)),
sketched AS (
  SELECT day, CASE WHEN value > 100 THEN -1 WHEN value > 30 THEN 0 ELSE 1 END AS band,
         CASE WHEN value = 0 THEN value ELSE sign(value) * pow(1.01 / 0.99::DOUBLE, ceil(ln(abs(value)) / ln(1.01 / 0.99::DOUBLE))) * 2 / (1.01 / 0.99::DOUBLE + 1) END AS middle
  FROM judged WHERE NOT late)
SELECT day, 'value_band' AS feature, CAST(band AS DOUBLE) AS value, count(*) AS n FROM sketched GROUP BY ALL
UNION ALL SELECT day, 'value_sketch', round(middle, 4), count(*) FROM sketched GROUP BY ALL
UNION ALL SELECT day, 'late', CAST(NULL AS DOUBLE), count(*) FROM judged WHERE late GROUP BY ALL""",
}
ORACLE |= {
    "drift_report_roundtrip": ORACLE["drift_report"],
    "champion_scores": ORACLE["model_scores"],
    "run_log_roundtrip": ORACLE["run_history"],
    "matrix_roundtrip": f"SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM ({ORACLE['robust_scale']})",
    "dataset_roundtrip": f"""WITH {LABELLED}, sides AS (SELECT unnest(['reference', 'current']) AS side)
SELECT side, Result, count(*) AS n, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in FEATURES)} FROM labelled, sides GROUP BY side, Result""",
    "preprocessor_roundtrip": f"""WITH filled AS ({ORACLE['knn_impute']}),
rows_ AS (SELECT {", ".join(CODES)} FROM (SELECT *, unnest(range(n)) AS copy FROM filled)),
params AS (SELECT {", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in CODES)} FROM rows_),
scaled AS (SELECT {", ".join(f"round(({c} - q_{c}[2]) / CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END, 4) + 0 AS {c}" for c in CODES)} FROM rows_, params)
SELECT {", ".join(CODES)}, count(*) AS n FROM scaled GROUP BY ALL""",
}
