"""Benchmark decontamination by canonical templates, in DataFrame functions.

Texts are cut into words (runs of letters, inner apostrophes allowed) and numbers. A template replaces numbers
by ``<num>``, a unit after a number by ``<unit>`` and capitalised words that do not begin a
sentence by ``<name>``; other words are lower-cased. Windows of five tokens are hashed twice:
as lower-cased words, and as a template where they hold a placeholder and enough literal words: two of five tokens,
half of a shorter window, one at least. A window of numbers or names alone says nothing about its text: it would meet
every other such window, so it counts as words only. The benchmark's windows are joined with the documents' by hash. Template matches count if their slots
are consistent: each value of the item stands for one value in the
document and no two for the same. So re-parameterised
questions are caught and chance matches of templates are not. Slots are compared over all matches of a (document, item)
pair; where these disagree, over the matches of one alignment (start in the document less start in the item, within
a slack), and the best alignment counts. So a second variant, or a chance match elsewhere in a long text, hides nothing.

A document is contaminated by an item if at least ``share`` of the item's windows are found in it.

Defined cases: null and empty texts have no windows. A text of fewer than five tokens is one
window, so a short item is found only where a whole text equals it. Rows alike in id and text are one document;
null ids are kept apart by their texts. Items given twice are both reported. Empty tables give no row. Extra columns are
ignored here and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.session import stored

WINDOW = 5
SHARE = 0.8
#: Largest number of benchmark windows that are broadcast; beyond it the join is a shuffle.
BROADCAST_WINDOWS = 400_000
#: Alignments up to this far apart are also judged together: a value may have more or fewer words than the item's.
SLACKS = (0, 1, 2, 4, 8)

TOKEN = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[0-9]+(?:[.,][0-9]+)*|[.!?:\n]"
# Unit words and signs looked for after a number.
UNITS = "km m cm mm mi mile miles foot feet ft inch inches kg g mg lb lbs pound pounds ton tons l ml litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees".split()


def _tokens(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The keys with ``tokens`` (lower-cased and template form) and ``hashes`` of the lower-cased forms.

    Each step is a column of its own: an expression inside a lambda would be computed for every token.
    """
    names = [f"_{k}" for k in range(len(keys))]
    cut = df.select(*[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)], F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("raw"))
    raw = F.col("raw")
    stop = lambda x: x.rlike(r"^[.!?:\n]$")

    def form(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(raw, i - 1)).otherwise(F.lit("."))
        lower = F.lower(x)
        template = (
            F.when(x.rlike("^[0-9]"), F.lit("<num>"))
            .when(lower.isin(UNITS) & before.rlike("^[0-9]"), F.lit("<unit>"))
            .when(x.rlike(r"^\p{Lu}") & ~stop(before), F.lit("<name>"))
            .otherwise(lower)
        )
        return F.struct(lower.alias("plain"), template.alias("template"))

    marked = cut.select(*names, F.filter(F.transform(raw, form), lambda x: ~stop(x["plain"])).alias("tokens"))
    return marked.select(*names, "tokens", F.transform("tokens", lambda x: F.xxhash64(x["plain"])).alias("hashes"))


def _starts(tokens: Column, window: int) -> Column:
    n = F.size(tokens)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _plain_windows(window: int) -> Column:
    hashes = F.col("hashes")
    return F.transform(_starts(hashes, window), lambda i: F.xxhash64(F.slice(hashes, i, window)))


def _template_windows(window: int) -> Column:
    """Start, hash and slots of the windows that hold a placeholder among enough literal words."""
    tokens = F.col("tokens")

    def described(i: Column) -> Column:
        part = F.slice(tokens, i, window)
        slots = F.transform(F.filter(part, lambda x: x["template"].startswith("<")), lambda x: F.concat_ws("|", x["template"], x["plain"]))
        return F.struct((i - 1).alias("at"), F.xxhash64(F.lit("template"), part["template"]).alias("hash"), slots.alias("slots"), F.size(part).alias("n"))

    def telling(x: Column) -> Column:
        filled = F.size(x["slots"])
        return (filled > 0) & (x["n"] - filled >= F.greatest(F.lit(1), F.floor(x["n"] / 2)))

    return F.filter(F.transform(_starts(tokens, window), described), telling)


def contaminated_pairs(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``doc_id, text_hash, item_id, n_windows, n_matched`` of the pairs with at least ``share`` of the item's windows."""
    items = _tokens(benchmark, "item_id").withColumnRenamed("_0", "item_id").where(F.size("tokens") > 0)
    # The item's text is its key as well: ids may be null or given twice.
    items = items.withColumn("item", F.xxhash64("item_id", "hashes")).dropDuplicates(["item_id", "item"])
    plain_items = items.select("item", F.posexplode(_plain_windows(window)).alias("at", "hash"))
    template_items = items.select("item", F.explode(_template_windows(window)).alias("w")).select("item", "w.at", "w.hash", F.col("w.slots").alias("item_slots"))
    sizes = items.select("item", "item_id", F.size(_starts(F.col("hashes"), window)).cast("long").alias("n_windows"))
    bounded = plain_items.count() <= BROADCAST_WINDOWS
    small = (lambda df: F.broadcast(df)) if bounded else (lambda df: df)

    docs = _tokens(documents.where(F.col("text").isNotNull()), "doc_id", F.xxhash64("text"))
    docs = docs.withColumnsRenamed({"_0": "doc_id", "_1": "text_hash"})
    plain = docs.select("doc_id", "text_hash", F.explode(_plain_windows(window)).alias("hash"))
    exact = plain.join(small(plain_items), "hash").select("doc_id", "text_hash", "item", "at", F.lit(None).cast("int").alias("shift"), F.array().cast("array<string>").alias("pairs"))
    holders = docs.where(F.exists("tokens", lambda x: x["template"].startswith("<")))
    templates = holders.select("doc_id", "text_hash", F.explode(_template_windows(window)).alias("w")).select("doc_id", "text_hash", "w.hash", "w.slots", F.col("w.at").alias("start"))
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.concat_ws("\t", a, b))
    alike = templates.join(small(template_items), "hash").select("doc_id", "text_hash", "item", "at", (F.col("start") - F.col("at")).cast("int").alias("shift"), pairs.alias("pairs"))

    key = ["doc_id", "text_hash", "item"]
    hits = stored(exact.unionByName(alike).distinct())
    found = hits.groupBy(*key, "at").agg(F.min(F.size("pairs")).alias("slots"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    gathered = found.groupBy(*key).agg(
        F.count("*").alias("n_all"),
        F.count(F.when(F.col("slots") == 0, 1)).alias("n_exact"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("slots") > 0, F.col("pairs"))))).alias("pairs"),
        F.collect_set(F.when(F.col("slots") == 0, F.col("at"))).alias("exact_at"),
    )
    side = lambda k: F.size(F.array_distinct(F.transform("pairs", lambda p: F.split(p, "\t")[k])))
    consistent = (side(0) == F.size("pairs")) & (side(1) == F.size("pairs"))
    enough = lambda n: n >= F.lit(share) * F.col("n_windows")
    judged = stored(gathered.join(small(sizes), "item").where(enough(F.col("n_all"))).withColumn("consistent", consistent).drop("pairs"))

    # Pairs whose matches disagree as a whole: every alignment by itself, beside the exact matches.
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    unclear = judged.where(~F.col("consistent") & ~enough(F.col("n_exact")))
    loose = hits.alias("h").join(unclear.alias("o"), same).where(F.col("shift").isNotNull() & ~F.array_contains("exact_at", F.col("at"))).select(*[f"h.{k}" for k in key], "at", "shift", "pairs")
    spans = F.flatten(F.array(*[F.transform(F.sequence(F.lit(0), F.lit(w)), lambda d, w=w: F.struct(F.lit(w).alias("slack"), (F.col("shift") - d).alias("from"))) for w in SLACKS]))
    aligned = (
        loose.withColumn("span", F.explode(spans))
        .groupBy(*key, "span")
        .agg(F.count_distinct("at").alias("n"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
        .where(consistent)
        .groupBy(*[F.col(k).alias(f"_{k}") for k in key])
        .agg(F.max("n").alias("n_aligned"))
    )
    best = judged.join(aligned, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left")
    matched = F.when(F.col("consistent"), F.col("n_all")).otherwise(F.col("n_exact") + F.coalesce("n_aligned", F.lit(0)))
    return best.withColumn("n_matched", matched).where(enough(F.col("n_matched"))).select("doc_id", "text_hash", "item_id", "n_windows", "n_matched")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The documents that no item contaminates, with their own columns."""
    found = contaminated_pairs(documents, benchmark, window, share).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    match = F.col("doc.doc_id").eqNullSafe(F.col("bad._id")) & (F.xxhash64("doc.text") == F.col("bad._hash"))
    return documents.alias("doc").join(found.alias("bad"), match, "left_anti")


_SQL_TOKEN = TOKEN.replace("'", "''")
_SQL_UNITS = ", ".join(f"'{u}'" for u in UNITS)
ORACLE = rf"""
WITH source AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT side, id, regexp_extract_all(text, '{_SQL_TOKEN}') AS raw FROM source),
one AS (SELECT side, id, unnest(raw) AS x, generate_subscripts(raw, 1) AS p FROM cut),
two AS (SELECT *, lag(x, 1, '.') OVER (PARTITION BY side, id ORDER BY p) AS before FROM one),
marked AS (
  SELECT side, id, p, lower(x) AS plain, CASE WHEN regexp_matches(x, '^[0-9]') THEN '<num>'
    WHEN lower(x) IN ({_SQL_UNITS}) AND regexp_matches(before, '^[0-9]') THEN '<unit>'
    WHEN regexp_matches(x, '^\p{{Lu}}') AND NOT regexp_matches(before, '^[.!?:\n]$') THEN '<name>' ELSE lower(x) END AS tpl
  FROM two WHERE NOT regexp_matches(x, '^[.!?:\n]$')),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY side, id ORDER BY p) AS i, count(*) OVER (PARTITION BY side, id) AS n FROM marked),
every AS (
  SELECT side, id, i, n, list(plain) OVER w AS ps, list(tpl) OVER w AS ts FROM numbered
  WINDOW w AS (PARTITION BY side, id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
win AS (SELECT * FROM every WHERE i <= greatest(n - {WINDOW - 1}, 1)),
item AS (SELECT * FROM win WHERE side = 'b'),
doc AS (SELECT * FROM win WHERE side = 'd'),
exact AS (SELECT DISTINCT doc.id AS doc_id, item.id AS item_id, item.i FROM doc JOIN item ON doc.ps = item.ps),
alike AS (
  SELECT doc.id AS doc_id, item.id AS item_id, item.i, unnest(item.ps) AS a, unnest(doc.ps) AS b, unnest(item.ts) AS t
  FROM doc JOIN item ON doc.ts = item.ts WHERE array_to_string(item.ts, ' ') LIKE '%<%'
    AND len(list_filter(item.ts, lambda t: t NOT LIKE '<%')) >= greatest(1, len(item.ts) // 2)),
loose AS (SELECT * FROM alike ANTI JOIN exact USING (doc_id, item_id, i)),
slots AS (SELECT DISTINCT doc_id, item_id, t || '|' || a AS a, t || '|' || b AS b FROM loose WHERE t LIKE '<%'),
fits AS (
  SELECT doc_id, item_id, count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT b) AS consistent FROM slots GROUP BY ALL),
found AS (
  SELECT doc_id, item_id, count(DISTINCT i) AS n_all, count(DISTINCT i) FILTER (WHERE kind = 'e') AS n_exact
  FROM (SELECT doc_id, item_id, i, 'e' AS kind FROM exact UNION ALL SELECT doc_id, item_id, i, 't' FROM loose) GROUP BY ALL),
size AS (SELECT id AS item_id, count(*) AS n_windows FROM item GROUP BY ALL)
SELECT doc_id, item_id, n_windows, CASE WHEN coalesce(consistent, true) THEN n_all ELSE n_exact END AS n_matched
FROM found JOIN size USING (item_id) LEFT JOIN fits USING (doc_id, item_id)
WHERE CASE WHEN coalesce(consistent, true) THEN n_all ELSE n_exact END >= {SHARE} * n_windows
"""
