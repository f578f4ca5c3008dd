"""Removal of later copies of repeated line runs, in DataFrame functions.

A run is a number of consecutive lines with at least ``min_words`` words together. A line goes
if it is in a run whose lines also stand, one after the other, at an earlier place; places are
ordered by (doc_id, text hash, line). Lines without a word are passed over when runs are formed and stay.

Winnowing: from every line a window reaches as far as it needs for ``min_words`` words, forwards
and backwards. The smallest line hash of a window is its fingerprint, so two copies of a run
share theirs. Fingerprints found at one position only end the search for their windows;
those left are joined on the hash of all their lines. Forward windows settle a run up to its last
``min_words`` words and backward windows the rest. No match is extended from fingerprint positions: hashes of whole
windows replace that step, since every line of a repeated run is in a repeated window, and extension
would need a row per pair of places. Every window is compared with its first place only, so
a run that fills a third of all rows costs one row per copy.

Defined cases: a null text stays null with no lines; an empty text stays. Rows alike in id
and text are one place: they are cut alike and not as copies of each other. Runs that
overlap their own copy (one line a thousand times) keep their first window's first line. An
empty table gives no row. Extra columns, also ones called like inner columns, come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.session import stored

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _window_length(words: Column, at: Column, min_words: int) -> Column:
    """Lines from ``at`` (from 0) on that hold ``min_words`` words; null where the text ends before.

    Each line has a word, so no window has more than ``min_words`` lines.
    """
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("lines"))
    step = lambda a, w: F.when(a["words"] >= min_words, a).otherwise(F.struct((a["words"] + w).alias("words"), (a["lines"] + 1).alias("lines")))
    return F.aggregate(F.slice(words, at + 1, min_words), start, step, lambda a: F.when(a["words"] >= min_words, a["lines"]))


def _windows(min_words: int) -> Column:
    """Forward and backward windows of a document: first line, number, fingerprint and its line, hash of all.

    Works on the columns ``words``, ``back`` (the same backwards) and ``hash``; they are columns, as
    an expression inside a lambda would be computed anew for every line.
    """
    words, back, hashes, n = F.col("words"), F.col("back"), F.col("hash"), F.size("hash")

    def spans(at: Column) -> Column:
        behind = F.struct(at.alias("at"), _window_length(words, at, min_words).alias("n"))
        before = F.transform(F.array(_window_length(back, at, min_words)), lambda k: F.struct((n - at - k).alias("at"), k.alias("n")))
        return F.concat(F.array(behind), before)

    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), spans))
    every = F.array_distinct(F.filter(every, lambda s: s["n"].isNotNull()))

    def described(s: Column) -> Column:
        part = F.slice(hashes, s["at"] + 1, s["n"])
        low = F.array_min(part)
        return F.struct(
            s["at"].alias("at"),
            s["n"].alias("n"),
            low.alias("print"),
            (s["at"] + F.array_position(part, low).cast("int") - 1).alias("print_at"),
            F.xxhash64(F.lit(29), part).alias("key"),
        )

    return F.transform(every, described)


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_hash, lines``: the line numbers (from 0) to remove, where there are any."""
    cut = F.split("text", "\n", -1)
    described = F.transform(cut, lambda x, i: F.struct(i.alias("line"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words"), F.xxhash64(x).alias("hash")))
    lines = (
        documents.where(F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.filter(described, lambda x: x["words"] > 0).alias("lines"))
        .where(F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["words"]) >= min_words)
    )
    table = stored(lines.select("doc_id", "text_hash", "lines.line", "lines.words", "lines.hash", F.reverse("lines.words").alias("back")))
    windows = table.select("doc_id", "text_hash", "line", _windows(min_words).alias("w"))
    prints = windows.select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("w", lambda x: F.struct(x["print"].alias("print"), x["print_at"].alias("at"))))).alias("p"))
    shared = prints.groupBy("p.print").agg(F.count("*").alias("places")).where("places > 1").select("print")
    each = windows.select("doc_id", "text_hash", F.explode("w").alias("w"), "line").select(
        "doc_id", "text_hash", "w.at", "w.n", "w.print", "w.key", F.slice("line", F.col("w.at") + 1, F.col("w.n")).alias("covers")
    )
    candidates = stored(each.join(shared, "print", "left_semi").drop("print"))
    first = candidates.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("first"), F.count("*").alias("places")).where("places > 1").select("key", "first")
    later = candidates.join(first, "key").where(F.struct("doc_id", "text_hash", "at") > F.col("first"))
    return later.select("doc_id", "text_hash", F.explode("covers").alias("line")).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """``documents`` with shortened texts, plus, with ``counts``, ``n_lines`` and ``n_removed`` (long; they replace columns of that name)."""
    removed = repeated_lines(documents, min_words).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lines").alias("_lines"))
    match = F.col("doc.doc_id").eqNullSafe(F.col("cut._id")) & (F.xxhash64("doc.text") == F.col("cut._hash"))
    joined = documents.alias("doc").join(removed.alias("cut"), match, "left")
    cut = F.split("doc.text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("cut._lines"))
    shorter = F.array_join(F.transform(kept, lambda i: F.get(cut, i)), "\n")
    own = [F.when(F.col("cut._lines").isNull(), F.col("doc.text")).otherwise(shorter).alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in documents.columns if not counts or c not in ("n_lines", "n_removed")]
    if not counts:
        return joined.select(*own)
    return joined.select(
        *own,
        F.when(F.col("doc.text").isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_lines"),
        F.coalesce(F.size("cut._lines"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM line),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
  FROM worded WHERE w > 0),
doc AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM numbered GROUP BY doc_id),
forth AS (
  SELECT a.doc_id, a.i AS i, b.i AS j FROM numbered a ASOF JOIN numbered b ON a.doc_id = b.doc_id AND b.upto >= a.upto - a.w + 50),
back AS (
  SELECT b.doc_id, a.i AS i, b.i AS j FROM numbered b ASOF JOIN (SELECT doc_id, i, upto - w AS before FROM numbered) a
  ON b.doc_id = a.doc_id AND a.before <= b.upto - 50),
win AS (
  SELECT doc_id, i, j, md5(array_to_string(ls[i:j], chr(10))) AS k FROM (SELECT * FROM forth UNION SELECT * FROM back) JOIN doc USING (doc_id)),
first AS (SELECT k, min((doc_id, i)) AS f FROM win GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT n.doc_id, n.pos FROM win JOIN first USING (k) JOIN numbered n ON n.doc_id = win.doc_id AND n.i BETWEEN win.i AND win.j
  WHERE (win.doc_id, win.i) > f),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_removed
  FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
