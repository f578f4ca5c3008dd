"""Byte-level BPE, cross-tokenizer alignment."""

import base64
import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from lurescope.llm import alignment, bytepairs, queries, spacechunks

FULL = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None, "", " ", "\n", "a", "don't  've it's", "tab\tq  \t z", "<|endoftext|> a <s> <0x41>", "a\x1cb\x85c​d", "日本語 テキスト 12 3",
    "a" * 3000, "ab" * 700 + "c", " " * 5000 + "x", "x²3½ ǀ_b don’t", "12345678901234567890" * 30, "\r\n\r\n x\r", "\U0001f600\U0001f468‍\U0001f469 é ﬁ \x00b�",
    " two  spaces   three ", "▁x ▁ y", "𝔘𝔫𝔦", "ß" * 500, "<0x0A>",
]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_are_cut_at_single_spaces(monkeypatch):
    assert spacechunks.chunks("a b  c d \n e f") == ["a", "b  c", "d \n e", "f"]
    assert spacechunks.chunks(" a b ") == [" a", "b "] and spacechunks.chunks("") == [""]
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("ab \n\t\u3000", k=60))
        assert " ".join(spacechunks.chunks(text)) == text
        windows = list(spacechunks.windows(text, 7))
        assert "".join(windows) == text
        assert [c for w in windows for c in spacechunks.chunks(w.removeprefix(" ") if w is not windows[0] else w)] == spacechunks.chunks(text)
    regular = regex.compile(r"\p{White_Space}")
    assert all(chr(c).isspace() for c in range(0x110000) if regular.match(chr(c)))


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_encoding_equals_the_library(spark, library):
    rng = random.Random(3)
    alphabet = "abcdet'sn 12.\n\té漢😀 "
    texts = [*ODD_TEXTS, *("".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(400))]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    mine = bytepairs.public_pairs()
    for text in texts:
        ids = library.encode_ordinary(text or "")
        assert mine.encode(text) == packed(ids), text
        assert mine.decode(packed(ids)) == (text or "").encode()
    plain = bytepairs.BytePairs(mine.ranks, public_tokenizers.PATTERN, spaces_begin=False)
    assert all(plain.encode(t) == mine.encode(t) for t in texts[:100])


def plain_merges(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_equals_the_plain_search_on_small_vocabularies():
    rng = random.Random(5)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        made = [b"a", b"b", b"c"]
        for k in range(rng.randint(1, 25)):
            token = rng.choice(made) + rng.choice(made)
            if token not in ranks:
                ranks[token] = 256 + k
                made.append(token)
        for _ in range(20):
            piece = bytes(rng.choices(b"abc", k=rng.randint(2, 40)))
            if piece not in ranks:
                assert bytepairs.merged_ids(piece, ranks) == plain_merges(piece, ranks)


def test_one_very_long_match_takes_no_quadratic_time(library):
    mine = bytepairs.public_pairs()
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh", k=200_000))
    start = time.perf_counter()
    ids = mine.encode(long)
    assert time.perf_counter() - start < 30
    assert ids == packed(library.encode_ordinary(long))
    assert mine.decode(ids) == long.encode()
    blanks = mine.encode(" " * 1_000_000 + "x")
    assert mine.decode(blanks) == b" " * 1_000_000 + b"x"


def test_store_of_matches_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bytepairs, "KEPT", 5)
    mine = bytepairs.public_pairs()
    text = "one two  three four five six seven eight nine ten " * 3
    assert mine.encode(text) == packed(library.encode_ordinary(text)) and len(mine.kept) <= 5


def test_unknown_ids_and_incomplete_vocabularies_are_errors():
    mine = bytepairs.public_pairs()
    with pytest.raises(KeyError):
        mine.decode(packed([60_000]))
    with pytest.raises(ValueError):
        bytepairs.BytePairs({b"a": 0}, ".")


def expected_digests(rows, library):
    out = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_op13_query(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FULL}/documents.parquet").collect()]
    got = queries.QUERIES["op13_bytepairs"](spark, FULL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_digests(rows, library)


def test_encoding_of_odd_rows(spark, odd, odd_rows, none, library):
    assert bytepairs.digests(none).count() == 0
    got = sorted(map(tuple, bytepairs.digests(odd).collect()), key=repr)
    assert got == expected_digests([r[:2] for r in odd_rows], library)
    carried = bytepairs.decode_ids(bytepairs.encode_texts(odd))
    assert carried.columns == [*odd.columns, "ids", "decoded"] and carried.count() == len(odd_rows)


# --- alignment --------------------------------------------------------------


def byte_letters():
    """The same table from the vocabulary itself: single-byte tokens are the first 256 ids of its rank file."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {a.id_to_token(i): ranks[i] for i in range(50256)}


def plain_alignment(rows):
    """Whole texts by both libraries, ends from decoded bytes alone, all overlapping pairs."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    found, held = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a_ids, b_ids = a.encode(raw.decode(), add_special_tokens=False).ids, b.encode(text or "")
        a_bytes = [letters[a.id_to_token(i)] for i in a_ids]
        pieces = [b.id_to_piece(i) for i in b_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(b_ids, pieces, strict=True)]
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            found.append((doc_id, [], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links, i, j = [], 0, 0
        for i in range(len(a_ids)):
            start = a_ends[i - 1] if i else 0
            while j and b_ends[j - 1] > start:
                j -= 1
            while j < len(b_ids) and (b_ends[j - 1] if j else 0) < a_ends[i]:
                if b_ends[j] > start:
                    links.append((a_ids[i], b_ids[j]))
                j += 1
            j = min(j, len(b_ids) - 1)
        cuts = sorted(set(a_ends) & set(b_ends))
        held.update(set(links))
        groups, x, y = [], 0, 0
        for cut in cuts:
            p, q = a_ends.index(cut, x) + 1, b_ends.index(cut, y) + 1
            groups.append(",".join(map(str, a_ids[x:p])) + "|" + ",".join(map(str, b_ids[y:q])))
            x, y = p, q
        found.append((doc_id, a_ids, b_ids, groups, links))
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, a_ids, b_ids, groups, links in found:
        best = sum(held[p] == highest[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a_ids else ""
        out.append((doc_id, len(a_ids), len(b_ids), len(groups), len(links), best, sum(held[p] for p in links), digest))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_op12_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FULL}/documents.parquet").collect()]
    got = queries.QUERIES["op12_alignment"](spark, FULL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == plain_alignment(rows)


@pytest.mark.parametrize("shared", [0, 40, alignment.SHARED])
def test_alignment_of_odd_rows(spark, odd, odd_rows, none, shared):
    assert alignment.alignment_digests(none, shared_limit=shared).count() == 0
    assert rows_of(alignment.alignment_digests(odd, shared_limit=shared)) == plain_alignment([r[:2] for r in odd_rows])
    rng = random.Random(shared)
    alphabet = ["a", "b", "  ", " ", "\n", "\u6f22", "\U0001f600", "\u00e9", "the", "ing", "<s>", "\t", "\u3000", "'s", "1"]
    rows = list(enumerate([*ODD_TEXTS, *("".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(150))]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert rows_of(alignment.alignment_digests(df, shared_limit=shared)) == plain_alignment(rows)


def test_spans_cover_the_text(spark):
    rows = list(enumerate(["caf\u00e9 \u6f22\u5b57 \U0001f469 x", None, "\u2581x"]))
    found = alignment.align_tokens(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()
    raw = b" " + rows[0][1].encode()
    for side in ("a", "b"):
        lengths = np.frombuffer(found[0][f"{side}_lengths"], "<u4")
        assert lengths.sum() == len(raw) and len(lengths) == found[0][f"n_{side}"] and (lengths > 0).all()
        assert all(not found[k][f"{side}_ids"] and found[k]["groups_sha256"] == "" for k in (1, 2))


def test_whole_texts_where_pieces_cross_spaces(spark):
    both = alignment.public_tokenizers_pair()
    assert both.b_begins_at_spaces
    both.b_begins_at_spaces = False
    texts = ["one two three", " lead", "x"]
    whole = [x[0] for x in alignment._Aligner(both, True).texts(texts)]
    both.b_begins_at_spaces = True
    parts = alignment._Aligner(both, True).texts(texts)
    assert [x.sides[0] for x in whole] == [b"".join(y.sides[0] for y in p) for p in parts]
    assert [x.groups for x in whole] == [";".join(y.groups for y in p) for p in parts]


def test_bounded_store_and_windows_change_nothing(monkeypatch):
    both = alignment.public_tokenizers_pair()
    text = " ".join(f"w{i % 37} caf\u00e9\u6f22 x{i}" for i in range(400))
    expected = alignment._Aligner(both, True).texts([text, "a b", None, "\u2581"])
    monkeypatch.setattr(alignment, "KEPT", 7)
    monkeypatch.setattr(alignment, "TOGETHER", 50)
    monkeypatch.setattr(spacechunks, "WINDOW", 100)
    monkeypatch.setattr(spacechunks.windows, "__defaults__", (100,))
    small = alignment._Aligner(both, True)
    assert small.texts([text, "a b", None, "\u2581"]) == expected and sum(map(len, small.kept)) <= 7
    assert expected[2] is None and expected[3] is None


def test_one_passage_in_a_third_of_all_rows(spark):
    rng = random.Random(9)
    rows = [(k, "shared passage of words" if k % 3 == 0 else "".join(rng.choices("abc de", k=30))) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert rows_of(alignment.alignment_digests(df, shared_limit=30)) == plain_alignment(rows)


def test_a_worker_keeps_its_matches_over_tasks():
    from lurescope.llm import bytepairs

    pairs = bytepairs.public_pairs()
    pairs.encode("Zwirbeldachs und Quastenflosser")
    assert bytepairs.public_pairs() is pairs and " Quastenflosser" in bytepairs.public_pairs().kept
    assert pairs.encode("é" * 70) and "é" * 70 not in pairs.kept


def test_words_between_marks_are_encoded_once(monkeypatch):
    both = alignment.public_tokenizers_pair()
    assert both.units("it's,\nAb") == ["it", "'s", ",\n", "Ab"] and both.units("a.\n\nb_漢,c") == ["a", ".\n\nb", "_漢,", "c"]
    given, align = [], both.align
    monkeypatch.setattr(both, "align", lambda parts, *more: given.extend(parts) or align(parts, *more))
    aligner = alignment._Aligner(both, False)
    aligner.texts(["Zwirbel, quast. x"])
    given.clear()
    aligner.texts(["quast, Zwirbel. quast Zwirbel", "x."])
    assert given == []
    aligner.texts(["".join(f"{i}," for i in range(5_000))])  # a long chunk stays whole, its units aren't held one by one
    assert len(given) == 1
    worker = alignment._worker_aligner(alignment.public_tokenizers_pair, False)
    assert alignment._worker_aligner(alignment.public_tokenizers_pair, False) is worker


def test_units_join_to_the_whole_texts_tokens():
    both, plain = alignment.public_tokenizers_pair(), alignment.public_tokenizers_pair()
    assert both.b_begins_at_marks
    plain.b_begins_at_marks = plain.b_begins_at_spaces = False  # whole texts
    rng = random.Random(4)
    alphabet = [*"abC'’s.,!_\n\t 12é½ß́×漢#<▁", "  ", "don't", "''", "\r\n", "\n\n", "<|endoftext|>", "\x85", "\x1c", "the"]
    units, whole = (alignment._Aligner(x, True) for x in (both, plain))
    for _ in range(60):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(40)]
        for text, parts, one in zip(texts, units.texts(texts), whole.texts(texts), strict=True):
            assert (parts is None) == (one is None), text
            if parts is not None:
                assert ";".join(x.groups for x in parts) == one[0].groups and b"".join(x.links for x in parts) == one[0].links, text
                assert [b"".join(x.sides[k] for x in parts) for k in range(4)] == [*one[0].sides], text
                assert [sum(x[k] for x in parts) for k in (2, 3, 4)] == [*one[0][2:5]], text
