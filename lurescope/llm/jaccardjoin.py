"""Exact Jaccard join of documents on word n-grams, with several global token orders as filters.

Two documents link if their sets' intersection is at least ``percent`` hundredths of their
union. Documents with equal sets form one node, so copies are never compared.

1. Every node's tokens (64-bit hashes) go, packed, to the token's partition, which finds how many nodes
   hold each token. Tokens of one node only can't be shared: their number is all that is
   kept of them. The others return to their node with a class of their frequency.
2. Order 0 sorts by frequency class and hash, rarest first. Similar sets share a token in their prefixes
   (n - ceil(percent n / 100) + 1 tokens); most documents have that many tokens of their own and are done. Orders 1 and
   2 break frequency ties by other hashes; a candidate pair must share a prefix token under
   every order before it is verified.
3. In each token's group every node is compared with the group's centre (the node where the
   token stands first). Links give first components.
4. What remains are candidates in different components. One of two linked nodes has the
   token in the shorter index prefix, and sizes are bounded by the positions left, so nodes meet by (token,
   size class) only. Pairs inside a component are never made: a group of thousands of near copies costs
   about one pair a member.

Verified intersections are of whole sets. Positions, sizes and components only rule out
what can't be a new link, so no link between components is lost.

Defined cases: null or empty texts, or texts without words, have an empty set and are linked
with nothing. A text with fewer words than a shingle is one shingle. Rows that share an id are
nodes of their own; their component is the same only if linked. Null ids get the least known id of
their component, or null. An empty table gives no row. Extra columns are ignored, and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.llm.components import components
from lurescope.llm.handback import giving_back
from lurescope.llm.textblocks import Block, blocks, mixed, ngrams, words
from lurescope.session import stored

ORDERS = 3
#: Tokens a task packs before it sends them.
PACKED_TOKENS = 1 << 20
#: Copies up to this number are told to the tokenizing tasks by broadcast; beyond it they are shuffled.
BROADCAST_COPIES = 1_000_000
#: Size classes are a factor of this apart.
SIZE_STEP = 1.02


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by text, and the text of each."""
    w = words(block, lower=True)
    hashes, text = ngrams(w, tuple(range(size)))
    number = np.diff(w.first_word)
    short = np.flatnonzero((number > 0) & (number < size))
    if len(short):
        whole = np.array([int(_whole(w.hash[a : a + n])) for a, n in zip(w.first_word[short], number[short], strict=True)], dtype=np.uint64)
        hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def _whole(hashes: np.ndarray) -> np.uint64:
    total = np.full(1, len(hashes), dtype=np.uint64)
    for h in hashes:
        total = mixed(total * np.uint64(31) + h)
    return total[0]


def _sets(documents: DataFrame, size: int, with_tokens: bool) -> DataFrame:
    """``doc_id, text_hash, n, node`` per row (node 0 for an empty set), and the packed tokens if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text_hash")
            for block in blocks(batch.column("text")):
                hashes, text = shingle_sets(block, size)
                cut = np.searchsorted(text, np.arange(block.count + 1))
                n = np.diff(cut)
                node = np.zeros(block.count, dtype=np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    # Two sums of the set's hashes, mixed differently, and its size name the set.
                    one, two = (np.add.reduceat(mixed(hashes ^ np.uint64(k)), cut[full]) for k in (0x1234567, 0x7654321))
                    node[full] = mixed(mixed(one) + np.uint64(3) * two + n[full].astype(np.uint64)) | np.uint64(1)
                columns = [ids.slice(block.first, block.count), texts.slice(block.first, block.count), pa.array(n.astype(np.int64)), pa.array(node.view(np.int64))]
                if with_tokens:
                    columns.append(pa.array([hashes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
                yield pa.record_batch(columns, ["doc_id", "text_hash", "n", "node", *["tokens"] * with_tokens])

    schema = "doc_id bigint, text_hash bigint, n bigint, node bigint" + ", tokens binary" * with_tokens
    return documents.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(giving_back(run), schema)


def _packed(keys: np.ndarray, columns: dict[str, np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """A row per part with its entries' columns as bytes, in the order given."""
    order = np.argsort(keys, kind="stable")
    cut = np.searchsorted(keys[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(cut))
    arrays = [pa.array(used.astype(np.int32))]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        arrays.append(pa.array([values[cut[k] : cut[k + 1]].tobytes() for k in used], pa.binary()))
    yield pa.record_batch(arrays, ["part", *columns])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and its length."""
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(values)))


def _joined(batches: Iterator[pa.RecordBatch], name: str, kind: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for b in batches for x in b.column(name)]


#: Entries on their way to a partition; nodes and sizes repeat, and the tokens' top byte is in the part.
_ENTRY = np.dtype([("node", "<i8"), ("n", "<i4"), ("count", "<i4")])


def _send_tokens(nodes: DataFrame, parts: int) -> DataFrame:
    """Every node's tokens to their partitions: per row the nodes with their number of tokens, then 7 bytes a token."""

    def pack(node: list[int], n: list[int], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in tokens])
        hashes = np.concatenate(tokens)
        owner = np.repeat(np.arange(len(node)), sizes)
        part = ((hashes >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # owners stay in order within a part
        hashes, owner, part = hashes[order], owner[order], part[order]
        low = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :7]
        start, count = _runs(part * len(node) + owner)
        entry = np.zeros(len(start), dtype=_ENTRY)
        entry["node"], entry["n"], entry["count"] = np.array(node)[owner[start]], np.array(n)[owner[start]], count
        token_cut = np.searchsorted(part, np.arange(parts + 1))
        entry_cut = np.searchsorted(part[start], np.arange(parts + 1))
        used = np.flatnonzero(np.diff(token_cut))
        yield pa.record_batch(
            [
                pa.array(used.astype(np.int32)),
                pa.array([entry[entry_cut[k] : entry_cut[k + 1]].tobytes() for k in used], pa.binary()),
                pa.array([low[token_cut[k] : token_cut[k + 1]].tobytes() for k in used], pa.binary()),
            ],
            ["part", "entries", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, tokens, held = [], [], [], 0
        for batch in batches:
            for a, b, t in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"), strict=True):
                node.append(a)
                n.append(b)
                tokens.append(np.frombuffer(t.as_py(), np.uint64))
                held += len(tokens[-1])
                if held > PACKED_TOKENS:
                    yield from pack(node, n, tokens)
                    node, n, tokens, held = [], [], [], 0
        if node:
            yield from pack(node, n, tokens)

    return nodes.mapInArrow(giving_back(run), "part int, entries binary, tokens binary")


def _shared_tokens(sent: DataFrame, parts: int) -> DataFrame:
    """What each partition found in two nodes or more, packed by the node's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, hashes = [], []
        for batch in batches:
            for part, e, t in zip(batch.column("part").to_pylist(), batch.column("entries"), batch.column("tokens"), strict=True):
                entries.append(np.frombuffer(e.as_py(), _ENTRY))
                low = np.frombuffer(t.as_py(), np.uint8).reshape(-1, 7)
                wide = np.zeros((len(low), 8), dtype=np.uint8)
                wide[:, :7] = low
                # With the part in front the hash keeps its identity: the part is a function of the top bits.
                hashes.append(wide.view(np.uint64).ravel() ^ mixed(np.full(1, part + 1, dtype=np.uint64)))
        if not entries:
            return
        entry, token = np.concatenate(entries), np.concatenate(hashes)
        entries.clear()
        hashes.clear()
        owner = np.repeat(np.arange(len(entry), dtype=np.int32), entry["count"])
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        del order
        start, count = _runs(token)
        many = np.repeat(count >= 2, count)
        frequency = np.repeat(np.minimum(255, np.round(8 * np.log2(count))).astype(np.uint8), count)[many]
        token, owner = token[many], owner[many]
        del many
        order = np.argsort(owner, kind="stable")
        token, owner, frequency = token[order], owner[order], frequency[order]
        del order
        start, count = _runs(owner)
        found = entry[owner[start]]
        found["count"] = count
        part = (mixed(found["node"].view(np.uint64).copy()) % np.uint64(parts)).astype(np.int64)
        of_token = np.repeat(part, count)
        rows = {}
        for batch in _packed(part, {"entries": found}, parts):
            rows["part"], rows["entries"] = batch.column("part"), batch.column("entries")
        for batch in _packed(of_token, {"tokens": token, "frequency": frequency}, parts):
            rows["tokens"], rows["frequency"] = batch.column("tokens"), batch.column("frequency")
        if rows:
            yield pa.record_batch(list(rows.values()), list(rows))

    return sent.mapInArrow(giving_back(run), "part int, entries binary, tokens binary, frequency binary")


def _ordered(token: np.ndarray, frequency: np.ndarray, order: int) -> np.ndarray:
    """Places of the tokens in a global order: rarest first, ties by a hash of the order's own."""
    return np.lexsort((token if order == 0 else mixed(token ^ np.uint64(0x51ED270B * (order + 1))), frequency))


def _survivors(returned: DataFrame, percent: int) -> DataFrame:
    """Nodes with a shared token in their prefix: ``node, n, own`` (tokens of theirs alone), all shared tokens and their frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, tokens, frequencies = [], [], []
        for batch in batches:
            for e, t, f in zip(batch.column("entries"), batch.column("tokens"), batch.column("frequency"), strict=True):
                entries.append(np.frombuffer(e.as_py(), _ENTRY))
                tokens.append(np.frombuffer(t.as_py(), np.uint64))
                frequencies.append(np.frombuffer(f.as_py(), np.uint8))
        if not entries:
            return
        entry, token, frequency = np.concatenate(entries), np.concatenate(tokens), np.concatenate(frequencies)
        entries.clear()
        tokens.clear()
        frequencies.clear()
        node = np.repeat(entry["node"], entry["count"])
        size = np.repeat(entry["n"], entry["count"])
        del entry
        order = np.lexsort((token, node))
        token, frequency, node, size = token[order], frequency[order], node[order], size[order]
        del order
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))  # a node sent twice
        token, frequency, node, size = token[new], frequency[new], node[new], size[new]
        start, count = _runs(node)
        n = size[start].astype(np.int64)
        own = n - count
        prefix = n - -(-percent * n // 100) + 1
        rows = np.flatnonzero(own < prefix)
        for some in np.array_split(rows, max(1, len(rows) // 2000)):
            cut = [(start[k], start[k] + count[k]) for k in some]
            yield pa.record_batch(
                [
                    pa.array(node[start[some]]),
                    pa.array(n[some]),
                    pa.array(own[some]),
                    pa.array([token[a:b].tobytes() for a, b in cut], pa.binary()),
                    pa.array([frequency[a:b].tobytes() for a, b in cut], pa.binary()),
                ],
                ["node", "n", "own", "tokens", "frequency"],
            )

    return returned.mapInArrow(giving_back(run), "node bigint, n bigint, own bigint, tokens binary, frequency binary")


def _prefixes(vectors: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, rest`` of the shared tokens in a node's prefix under order 0; rest counts the tokens from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, n, own, t, f in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "own", "tokens", "frequency")), strict=True):
                token, frequency = np.frombuffer(t, np.uint64), np.frombuffer(f, np.uint8)
                room = n - -(-percent * n // 100) + 1 - own
                first = token[_ordered(token, frequency, 0)[:room]]
                out.append((first.view(np.int64), np.full(len(first), node), np.full(len(first), n), n - own - np.arange(len(first))))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["token", "node", "n", "rest"])

    return vectors.mapInArrow(giving_back(run), "token bigint, node bigint, n bigint, rest bigint")


def _verified(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that share a prefix token under every order and then link."""
    left = vectors.select(*[F.col(c).alias(f"a_{c}") for c in vectors.columns])
    right = vectors.select(*[F.col(c).alias(f"b_{c}") for c in vectors.columns])
    both = pairs.join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node")).drop("a_node", "b_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                sides = []
                for s in "ab":
                    token, frequency = np.frombuffer(column[f"{s}_tokens"][i].as_py(), np.uint64), np.frombuffer(column[f"{s}_frequency"][i].as_py(), np.uint8)
                    n, own = column[f"{s}_n"][i].as_py(), column[f"{s}_own"][i].as_py()
                    sides.append((token, frequency, n, n - -(-percent * n // 100) + 1 - own))
                (x, fx, n, p), (y, fy, m, q) = sides
                if all(len(np.intersect1d(x[_ordered(x, fx, k)[:p]], y[_ordered(y, fy, k)[:q]], assume_unique=True)) for k in range(1, ORDERS)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = 100 * common >= percent * (n + m - common)
            yield pa.record_batch([column["a"].filter(pa.array(linked)), column["b"].filter(pa.array(linked))], ["a", "b"])

    return both.mapInArrow(giving_back(run), "a bigint, b bigint")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP))).cast("int")


def links(vectors: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that connect every two linked nodes (not each link inside a component)."""
    within = lambda x, y: (100 + percent) * F.least(x["rest"], y["rest"]) >= percent * (x["n"] + y["n"])
    prefix = stored(_prefixes(vectors, percent))
    centre = prefix.groupBy("token").agg(F.max(F.struct("rest", "n", "node")).alias("centre"), F.count("*").alias("members")).where("members > 1")
    star = prefix.join(centre, "token").where("node <> centre.node").where(within({c: F.col(c) for c in ("rest", "n")}, F.col("centre")))
    pair = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    tried = stored(pair(star, F.col("node"), F.col("centre.node")))
    first = stored(_verified(tried, vectors, percent))

    label = components(first).select("node", F.col("component").alias("label"))
    named = stored(prefix.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    open_tokens = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    left = stored(named.join(open_tokens, "token", "left_semi"))
    # One of two linked nodes has the token within the index prefix.
    index = left.where((100 + percent) * F.col("rest") >= 2 * percent * F.col("n")).select("token", F.struct("node", "n", "rest", "label").alias("y"), _size_class(F.col("n")).alias("size"))
    least, most = F.ceil(F.col("n") * percent / 100), F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col("rest") * (100 + percent) / percent) - F.col("n"))
    probe = (
        left.select("token", F.struct("node", "n", "rest", "label").alias("x"), least.alias("least"), most.alias("most"))
        .where("least <= most")
        .select("token", "x", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))).alias("size"))
    )
    met = probe.join(index, ["token", "size"]).where(F.col("x.label") != F.col("y.label")).where(within(F.col("x"), F.col("y")))
    rest = pair(met, F.col("x.node"), F.col("y.node")).join(tried, ["a", "b"], "left_anti")
    return first.unionByName(_verified(stored(rest), vectors, percent))


def _linked_nodes(documents: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored ``doc_id, text_hash, n, node`` per row; ``node, least_id`` of every node; ``node, component`` of the linked ones."""
    spark = documents.sparkSession
    # Each part is a partition of its own (by id, not by a hash of it), twice the usual number: a task sorts its part in memory.
    # More would make the packets, of which every part sends one to every other, too many and too small.
    parts = min(65_536, 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    base = stored(_sets(documents, size, with_tokens=False))
    classes = base.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    several = classes.where("copies > 1").select("node", "least_id")
    copies = stored(base.join(several, "node").where(~F.col("doc_id").eqNullSafe(F.col("least_id"))).select(F.col("doc_id").alias("copy_id"), F.col("node").alias("copy_node")).distinct())
    bounded = copies.count() <= BROADCAST_COPIES
    same = F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("node") == F.col("copy_node"))
    nodes = _sets(documents, size, with_tokens=True).where("n > 0").join(F.broadcast(copies) if bounded else copies, same, "left_anti")
    sent = _send_tokens(nodes.select("node", "n", "tokens"), parts).repartitionById(parts, F.col("part"))
    returned = _shared_tokens(sent, parts).repartitionById(parts, F.col("part"))
    vectors = stored(_survivors(returned, percent))
    return base, classes, components(links(vectors, percent))


def similar_documents(documents: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, node, component_id`` per document; component_id is the least id reachable by links."""
    base, classes, joined = _linked_nodes(documents, size, percent)
    least = joined.join(classes.select("node", "least_id"), "node")
    of_component = least.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = joined.join(of_component, "component").select("node", "component_id")
    known = classes.select("node", "least_id").join(named, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    return base.join(known, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of every component, the one with the least id, and those linked with nothing; with their own columns.

    Only rows alike in id and text stay together. Null ids come last; the node and the text's hash settle ties.
    """
    base, _, joined = _linked_nodes(documents, size, percent)
    rows = base.where("n > 0").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.select("component", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node", "text_hash").alias("row"))
    first = rows.groupBy("component").agg(F.min("row").alias("first"), F.max("row").alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("component", "first")
    later = rows.join(first, "component").where(~F.col("row").eqNullSafe(F.col("first")))
    gone = later.select(F.col("row.doc_id").alias("_gone"), F.col("row.text_hash").alias("_hash")).distinct()
    match = F.col("doc.doc_id").cast("bigint").eqNullSafe(F.col("bad._gone")) & (F.xxhash64("doc.text") == F.col("bad._hash"))
    return documents.alias("doc").join(gone.alias("bad"), match, "left_anti")
