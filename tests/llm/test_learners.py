"""Classifiers: held-out accuracy on the small tables, defined results for odd rows."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lurescope.llm import langid, linear, quality, queries, toxicity
from lurescope.llm.textblocks import blocks, ngrams, words

FULL = "/root/testdata/sf0.01"


def learnt():
    return ~linear.held_out(F.col("doc_id"))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_words_match_the_contract():
    import pyarrow as pa

    texts = ["a  b\tc\x0bd", None, "", "één Ünï\x1fx", "one", " lead and trail "]
    got = []
    for block in blocks(pa.array(texts), limit=8):
        w = words(block)
        raw = block.data.tobytes()
        got += [[raw[w.start[k] : w.end[k]].decode() for k in range(w.first_word[t], w.first_word[t + 1])] for t in range(block.count)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    block = next(blocks(pa.array(["a b c", "a b c d"])))
    hashes, text = ngrams(words(block), (0, 1, 2))
    assert text.tolist() == [0, 1, 1] and hashes[0] == hashes[1] != hashes[2]


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 4000 else set()
    hit = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_query(spark):
    got = queries.op2_quality(spark, FULL).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{FULL}/documents.parquet").toPandas()
    for r in docs[docs.n_chars < 6000].head(250).itertuples():
        g = got.loc[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == plain_counts(r.text)
    assert ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)).equals(got.base_failed)
    assert not (got.kept & got.base_failed).any()
    known = got.join(spark.read.parquet(f"{FULL}/labels.parquet").toPandas().set_index("doc_id").quality.rename("label"), how="inner")
    judged = known[~known.base_failed]
    assert (judged.kept == (judged.label == 1)).mean() > 0.95


def test_quality_of_odd_rows(spark, odd, odd_rows, none, labels):
    model = quality.train_quality(odd, labels)
    got = quality.score_quality(odd, model).toPandas()
    assert len(got) == len(odd_rows)
    assert got[got.n_words == 0].base_failed.all() and (got.n_words == 60_000).sum() == 1
    assert sorted(got.n_dup_lines.tolist())[-1] == 2
    assert quality.score_quality(none, quality.train_quality(none, labels.limit(0))).count() == 0


def test_language_query(spark):
    got = queries.op3_language(spark, FULL).toPandas()
    docs = spark.read.parquet(f"{FULL}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) and (both.held_out == both.doc_id.map(held)).all()
    test = both[both.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.95
    assert both.score.between(0, 1).all()


def test_language_of_odd_rows(spark, odd, none):
    model = langid.train_languages(odd, learnt())
    got = langid.predict_languages(odd, model).toPandas()
    assert (got[got.doc_id.isin([3, 4, 5])].lang_pred == "und").all() and (got[got.doc_id.isin([3, 4, 5])].score == 0).all()
    assert (got[got.doc_id == 1].lang_pred == "en").all()
    empty = langid.train_languages(none, learnt())
    assert langid.predict_languages(none, empty).count() == 0
    assert (langid.predict_languages(odd, empty).toPandas().lang_pred == "und").all()


def test_bundle_is_the_sum_of_bound_vectors():
    encoder, letters = langid.Encoder(64), langid.letter_vectors(64)
    gram, count = langid.trigram_counts("abab c")
    total = np.zeros(64)
    for g, n in zip(gram, count, strict=True):
        total += n * np.roll(letters[g >> 16], 2) * np.roll(letters[(g >> 8) & 255], 1) * letters[g & 255]
    assert np.allclose(encoder.vector("abab c"), total / np.linalg.norm(total), atol=1e-5)


def test_toxicity_query(spark):
    got = queries.op10_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (got.held_out == got.doc_id.map(held)).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    test = got[got.held_out].merge(truth, on="doc_id")
    assert (test.predicted == test.toxic).mean() > 0.97
    caught = test[test.toxic == 1].predicted.mean()
    assert caught > 0.85, caught


def test_toxicity_of_odd_rows(spark, odd, odd_rows, none, labels):
    model = toxicity.train_toxicity(odd, labels, learnt())
    got = toxicity.score_toxicity(odd, model).toPandas()
    assert len(got) == len(odd_rows) and got.score.between(0, 1).all()
    kept = toxicity.reject_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == (got.predicted == 0).sum()
    assert set(kept.select("score").distinct().toPandas().score.dropna()) <= {"own"}
    flat = toxicity.train_toxicity(none, labels.limit(0), learnt())
    assert toxicity.score_toxicity(none, flat).count() == 0 and toxicity.score_toxicity(odd, flat).count() == len(odd_rows)


def test_sample_ignores_contradictions(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id bigint, text string")
    both = labels.unionByName(spark.createDataFrame([(2, 1, 0, None)], labels.schema))
    got = linear.labelled_sample(docs, both, "quality", 64, F.lit(True)).toPandas()
    assert got.text.tolist() == ["a"]
