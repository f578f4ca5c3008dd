"""Operators on copies against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from lurescope.llm import components, decontaminate, jaccardjoin, linededup, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    """Texts with exact and near copies, shared passages, repeated lines and short texts."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefg", k=r.randint(2, 6))) for _ in range(400)]
    line = lambda k: " ".join(r.choices(words, k=k)).capitalize() + "."
    passages = ["\n".join(line(r.randint(4, 30)) for _ in range(r.randint(1, 6))) for _ in range(4)]
    texts = []
    for i in range(n):
        kind = r.random()
        if i and kind < 0.3:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.6:
            lines = [line(r.randint(1, 25)) for _ in range(r.randint(1, 6))]
            lines.insert(r.randrange(len(lines) + 1), r.choice(passages))
            texts.append("\n".join(lines))
        elif kind < 0.65:
            texts.append("\n".join([line(9)] * r.randint(2, 30)))
        else:
            texts.append("\n".join(line(r.randint(1, 40)) for _ in range(r.randint(0, 8))))
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


def lines_left(rows, min_words):
    """Every repeated run, by trying all runs."""
    docs = [(i, [(at, x, len(WORD.findall(x))) for at, x in enumerate(t.split("\n")) if WORD.search(x)]) for i, t in rows]
    first, runs = {}, []
    for i, lines in docs:
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total >= min_words:
                    key = tuple(x for _, x, _ in lines[a : b + 1])
                    runs.append((key, i, a, b))
                    first[key] = min(first.get(key, (i, a)), (i, a))
    gone = defaultdict(set)
    lines_of = dict(docs)
    for key, i, a, b in runs:
        if (i, a) > first[key]:
            gone[i] |= {lines_of[i][k][0] for k in range(a, b + 1)}
    return {i: "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got == lines_left(rows, 50)


def test_line_dedup_of_odd_rows(spark, odd, odd_rows, none):
    got = linededup.dedup_lines(odd).toPandas()
    assert len(got) == len(odd_rows) and got[got.doc_id == 3].text.isna().all() and (got[got.doc_id == 4].text == "").all()
    assert (got[got.doc_id == 1].text != "").sum() in (0, 2)  # rows alike are one place
    plain = linededup.dedup_lines(odd, counts=False)
    assert plain.columns == odd.columns and set(plain.select("lines").toPandas()["lines"].dropna()) == {"own"}
    assert linededup.dedup_lines(none).count() == 0


def groups(rows, size, percent):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("seed", "size", "percent"), [(3, 4, 85), (4, 5, 80), (5, 1, 50)])
def test_jaccard_join(spark, seed, size, percent):
    rows = corpus(seed, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccardjoin.similar_documents(frame(spark, rows), size, percent).collect()}
    assert got == groups(rows, size, percent)


def test_jaccard_join_of_a_large_group(spark):
    """A chain of near copies: its ends don't link, its neighbours do."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(120), r.randint(0, 4)):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            base[(i * 7) % 120] = f"u{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccardjoin.similar_documents(frame(spark, rows)).collect()}
    assert got == groups(rows, 4, 85)


def test_jaccard_join_of_odd_rows(spark, odd, odd_rows, none):
    got = jaccardjoin.similar_documents(odd).toPandas()
    assert len(got) == len(odd_rows)
    assert (got[got.doc_id == 1].component_id == 1).all() and set(got[got.doc_id.isin([3, 4, 5])].n_shingles) == {0}
    kept = jaccardjoin.keep_one_of_each(odd)
    assert kept.columns == odd.columns and {3, 4, 5, 6}.issubset({r.doc_id for r in kept.collect()})
    assert jaccardjoin.similar_documents(none).count() == 0


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    third = " ".join(f"u{k}" for k in range(60))
    clean, lone = "A clean text with a null id and words of its own.", "Another text of a repeated id, alike to nothing."
    rows = [(1, base), (None, base + " end"), (None, clean), (2, base + " more"), (2, lone), (None, other), (None, other + " end"), (3, third), (3, third + " end"), (3, third.upper()), (4, ""), (None, None)]
    kept = [(r.doc_id, r.text) for r in jaccardjoin.keep_one_of_each(frame(spark, rows)).collect()]
    assert {(1, base), (None, clean), (2, lone), (4, ""), (None, None)} <= set(kept) and len(kept) == 7
    assert sum(d is None and (t or "").startswith("v0") for d, t in kept) == 1 and sum(d == 3 for d, _ in kept) == 1


def test_components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 470)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(root)}


def spans(rows, length, keep_first):
    places = defaultdict(list)
    data = {i: t.encode() for i, t in rows}
    for i in sorted(data):
        for p in range(len(data[i]) - length + 1):
            places[data[i][p : p + length]].append((i, p))
    gone = {i: bytearray(len(b)) for i, b in data.items()}
    for at in places.values():
        if len(at) > 1:
            for i, p in at[1 if keep_first else 0 :]:
                gone[i][p : p + length] = b"\1" * length
    return {i: (sum(g), sum(1 for x in bytes(g).split(b"\0") if x), bytes(c for c, f in zip(data[i], g, strict=True) if not f)) for i, g in gone.items()}


@pytest.mark.parametrize(("seed", "length"), [(6, 40), (7, 100)])
def test_substrings(spark, seed, length):
    rows = [*corpus(seed, 50), (50, "é" * 150), (51, "ab" * 200)]
    for keep_first in (False, True):
        got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(frame(spark, rows), length, keep_first).collect()}
        assert got == spans(rows, length, keep_first)
    digests = {r.doc_id: r.kept_sha256 for r in substrings.repeat_digests(frame(spark, rows), length).collect()}
    assert digests == {i: hashlib.sha256(x[2]).hexdigest() for i, x in spans(rows, length, False).items()}


def test_substrings_of_odd_rows(spark, odd, odd_rows, none):
    got = substrings.repeat_digests(odd, 100).toPandas()
    assert len(got) == len(odd_rows) and (got[got.doc_id.isin([3, 4])].n_bytes == 0).all()
    assert (got[got.doc_id == 1].n_removed == got[got.doc_id == 1].n_bytes).all()  # rows alike are copies
    kept = substrings.remove_repeats(odd, 100)
    assert set(odd.columns) <= set(kept.columns) and kept.count() == len(odd_rows)
    assert substrings.repeat_digests(none).count() == 0


ITEM = "If Anna buys 12 apples for 3 dollars each and then sells 5 of them, how much money does she have left at the end"


def test_templates_and_slots(spark):
    same = ITEM.replace("Anna", "Peter").replace("12", "40").replace("3 dollars", "7 euros")
    mixed = ITEM.replace("12 apples", "9 apples").replace("5 of", "9 of")  # two values of the item for one of the document
    rows = [(1, "Intro. " + ITEM.upper() + ". More."), (2, f"Some text before. {same} and after."), (3, f"Words. {mixed}."), (4, "If Anna buys nothing she has it all."), (5, ITEM[:60])]
    items = spark.createDataFrame([(0, ITEM), (1, None), (2, ""), (3, "two words")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(frame(spark, rows), items).collect()}
    assert got == {(1, 0), (2, 0)}


def test_variants_and_chance_hits_hide_no_copy(spark):
    one = ITEM.replace("Anna", "Peter").replace("12", "40").replace("3 dollars", "7 euros").replace("5 of", "6 of")
    two = ITEM.replace("Anna", "Maria").replace("12", "99").replace("3 dollars", "8 euros").replace("5 of", "2 of")
    wide = one.replace("Peter", "Peter Paul").replace(" apples", " green apples")
    filler = "Some words of another text stand here without a number. " * 200
    chance = "They paid 70 euros each and then left. "
    mixed = ITEM.replace("12 apples", "9 apples").replace("5 of", "9 of")
    scattered = " ".join(filler + ITEM[a : a + 45].replace("12", "40").replace("3", str(a)) for a in range(0, len(ITEM), 30))
    rows = [(1, f"Sheet. {one}? {two}?"), (2, filler + one + ". " + filler + chance), (None, f"Sheet. {one}? {two}?"), (3, f"{mixed}. {chance}"), (4, scattered), (5, f"{chance} {one}. {wide}.")]
    items = spark.createDataFrame([(0, ITEM), (None, ITEM)], "item_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontaminate.contaminated_pairs(frame(spark, rows), items).collect())
    assert got == sorted((str(d), str(i)) for d in (1, 2, 5, None) for i in (0, None))


def test_number_lists_are_no_copies(spark):
    lists = spark.range(2000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 40), k -> cast(abs(xxhash64(id, k)) % 100000 AS string)), ' ') AS text")
    items = spark.range(500).selectExpr("id AS item_id", "array_join(transform(sequence(1, 40), k -> cast(abs(xxhash64(id + 5000, k)) % 100000 AS string)), ' ') AS text")
    names = spark.createDataFrame([(-1, "the Anna Berta Clara Dora Emma Frida")], "item_id bigint, text string")
    own = spark.createDataFrame([(9000, None), (9001, "the Gerd Hans Ingo Jan Karl Lutz")], "doc_id bigint, text string")
    copy = items.where("item_id = 7").selectExpr("9002L AS doc_id", "text")
    got = decontaminate.contaminated_pairs(lists.unionByName(own).unionByName(copy), items.unionByName(names)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(9002, 7)]  # the same numbers are a copy, other numbers are not


def test_decontamination_of_odd_rows(spark, odd, odd_rows, none):
    items = spark.createDataFrame([(0, odd_rows[0][1][:200], "own"), (None, "x", None), (5, None, None), (0, odd_rows[0][1][:200], "own")], "item_id bigint, text string, n string")
    kept = decontaminate.drop_contaminated(odd, items)
    left = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and 1 not in left and 2 not in left and 7 not in left and left.count(None) == 1
    assert decontaminate.drop_contaminated(none, items).count() == 0
    assert decontaminate.drop_contaminated(odd, items.limit(0)).count() == len(odd_rows)
