"""Repeated byte strings across a corpus by longest-previous-factor arrays.

A suffix matters by its first ``length`` bytes (400) only: a position's longest previous factor reaches ``length``
exactly if its truncated suffix also starts at an earlier position, and its longest next factor if at a
later one. The truncated suffixes are put into suffix order - by 64-bit rank hashes, so that equal ones
are neighbours, ties by position - and the previous and next smaller positions in
that order are then read off the neighbours. Suffixes that can't have a partner are left out before:

1. Every window of ``length`` bytes has an anchor, its least 32-byte gram. Equal windows have equal
   anchors at the same place. Windows with one anchor are a run; its cover is all their bytes.
2. Runs meet by the anchor's gram. A gram found once ends the matter. Equal covers are copies
   throughout. Copies inside a task are settled there and one is sent on, so a text that fills a
   third of all rows sends one run a task.
3. Only where one gram has different covers (edits, borders of passages) suffixes are sorted, for one run of
   each cover. They are dealt by gram and place before the anchor; a gram with more than
   ``HOT_COVERS`` covers is dealt by the suffix hashes themselves.

With ``keep_first`` only later copies go (longest previous factor); otherwise every copy goes.

Defined cases: null texts are empty and give no span; texts shorter than ``length`` bytes have none.
Rows alike in id and text are copies of each other, but one place for ``keep_first``. Ids may be null
or repeated. An empty table gives no row. Extra columns are ignored by ``repeat_digests`` and kept by ``remove_repeats``, where
``kept`` (the bytes left), ``n_removed`` and ``n_spans`` replace columns of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lurescope.llm import packets
from lurescope.llm.bytewindows import anchors, window_hashes
from lurescope.llm.textblocks import blocks, mixed
from lurescope.session import stored

LENGTH = 400
#: Runs a task gathers, and settles copies among, before it sends them.
GATHERED = 1 << 18
HOT_COVERS = 50_000
#: Suffixes of a run that travel together.
TOGETHER = 32
_NULL = np.iinfo(np.int64).min

_RUN = np.dtype([("gram", "<u8"), ("cover", "<u8"), ("doc", "<i8"), ("text", "<i4"), ("at", "<i4"), ("windows", "<i2"), ("back", "<i2"), ("known", "i1"), ("count", "i1")])
_SUFFIX = np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<i4"), ("at", "<i4"), ("count", "<i2"), ("settled", "i1")])


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(int(_NULL)), dtype=np.int64)


def _nullable(doc: np.ndarray) -> pa.Array:
    return pa.array(doc, mask=doc == _NULL)


def _text_hash(text: Column) -> Column:
    return F.hash(text)


def _with_hash(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint"), _text_hash(F.col("text")).alias("text_hash"), "text")


def _block_runs(block, doc: np.ndarray, text_hash: np.ndarray, length: int) -> np.ndarray:
    anchor, grams = anchors(block.data, length)
    p = np.arange(len(anchor))
    text = np.searchsorted(block.starts, p, side="right") - 1
    whole = p + length <= block.starts[text + 1] - 1
    p, anchor, text = p[whole], anchor[whole], text[whole]
    start, windows = packets.runs(anchor, text)
    found = np.zeros(len(start), dtype=_RUN)
    p, anchor, text = p[start], anchor[start], text[start]
    raw = block.data.tobytes()
    found["cover"] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + n + length - 1]) for a, n in zip(p.tolist(), windows.tolist(), strict=True)), np.uint64, len(p))
    found["gram"], found["doc"], found["text"] = grams[anchor], doc[text], text_hash[text]
    found["at"], found["windows"], found["back"] = p - block.starts[text], windows, anchor - p
    # The anchor's place belongs to the cover, though equal covers have it in common.
    found["cover"] ^= mixed(found["gram"] + found["back"].astype(np.uint64))
    return found


def _by_position(found: np.ndarray, *first: np.ndarray) -> np.ndarray:
    return np.lexsort((found["at"], found["text"], found["doc"], *first))


def _send_runs(documents: DataFrame, length: int, parts: int) -> DataFrame:
    def pack(found: np.ndarray) -> pa.RecordBatch:
        found = found[_by_position(found, found["cover"])]
        start, n = packets.runs(found["cover"])
        part = (mixed(found["gram"].copy()) % np.uint64(parts)).astype(np.int64)
        copies = np.ones(len(found), dtype=bool)
        copies[start] = False
        found["known"][copies] = 2  # has an earlier copy: only to be reported, by any partition
        found["known"][start[n > 1]] = 1  # has a later copy
        part[copies] = np.arange(copies.sum()) % parts
        return packets.pack(found, np.zeros((0, 1), np.uint8), part, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            doc, text_hash = _ids(batch.column("doc_id")), np.asarray(batch.column("text_hash"), dtype=np.int32)
            for block in blocks(batch.column("text")):
                mine = slice(block.first, block.first + block.count)
                held.append(_block_runs(block, doc[mine], text_hash[mine], length))
                if sum(map(len, held)) > GATHERED:
                    yield pack(np.concatenate(held))
                    held = []
        if held:
            yield pack(np.concatenate(held))

    return _with_hash(documents).mapInArrow(run, packets.SCHEMA)


_MET = "doc_id bigint, text_hash int, at int, windows int, back int, gram bigint, repeated boolean, later boolean, sorted boolean, hot boolean"


def _met_runs(sent: DataFrame) -> DataFrame:
    """Runs that are copies (``repeated``; ``later`` if of an earlier one) or have suffixes to be sorted (``sorted``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = packets.unpack(batches, _RUN, 1)
        told = found[found["known"] == 2]
        found = found[found["known"] < 2]
        found = found[_by_position(found, found["cover"], found["gram"])]
        start, n = packets.runs(found["gram"], found["cover"])
        first = np.zeros(len(found), dtype=bool)
        first[start] = True
        repeated = np.repeat(n > 1, n) | (found["known"] > 0)
        of_gram, covers = packets.runs(found["gram"][start]) if len(start) else (start, n)
        covers = np.repeat(np.repeat(covers, covers), n)
        partly = first & (covers > 1)
        out = repeated | partly
        rows = np.concatenate([found[out], told])
        flags = [np.concatenate([x[out], np.full(len(told), y)]) for x, y in ((repeated, True), (~first, True), (partly, False), (covers > HOT_COVERS, False))]
        columns = [_nullable(rows["doc"]), *[pa.array(rows[c].astype(np.int32)) for c in ("text", "at", "windows", "back")]]
        yield pa.record_batch([*columns, pa.array(rows["gram"].view(np.int64) if len(rows) else np.zeros(0, np.int64)), *map(pa.array, flags)], [x.split()[0] for x in _MET.split(", ")])

    return sent.mapInArrow(run, _MET)


def _send_suffixes(documents: DataFrame, met: DataFrame, length: int, parts: int) -> DataFrame:
    """Hashes of the truncated suffixes of the runs to be sorted."""
    mine = met.where("sorted").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("gram", "at", "windows", "back", "repeated", "hot")).alias("runs"))
    mine = mine.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    joined = _with_hash(documents).join(mine, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))

    def pack(entries: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        entry, value = np.concatenate(entries), np.concatenate(hashes)
        low = np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8)[:, :6]
        return packets.pack(entry, low, (mixed(entry["key"].copy()) % np.uint64(parts)).astype(np.int64), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, hashes, held = [], [], 0
        for batch in batches:
            doc = _ids(batch.column("doc_id"))
            for k, (text_hash, text, found) in enumerate(zip(batch.column("text_hash").to_pylist(), batch.column("text"), batch.column("runs"), strict=True)):
                every = window_hashes(np.frombuffer(text.as_py().encode(), np.uint8), length)
                for r in found.as_py():
                    value = every[r["at"] : r["at"] + r["windows"]]
                    place = r["back"] - np.arange(len(value))  # bytes before the anchor
                    group = np.arange(len(value)) if r["hot"] else place // TOGETHER
                    start, count = packets.runs(group)
                    entry = np.zeros(len(start), dtype=_SUFFIX)
                    gram = np.array([r["gram"]], dtype=np.int64).view(np.uint64)
                    entry["key"] = mixed(gram + value) if r["hot"] else mixed(gram + group[start].astype(np.uint64))
                    entry["doc"], entry["text"], entry["at"], entry["count"], entry["settled"] = doc[k], text_hash, r["at"] + start, count, r["repeated"]
                    entries.append(entry)
                    hashes.append(value)
                    held += len(value)
                if held > 1 << 20:
                    yield pack(entries, hashes)
                    entries, hashes, held = [], [], 0
        if entries:
            yield pack(entries, hashes)

    return joined.select("doc_id", "text_hash", "text", "runs").mapInArrow(run, packets.SCHEMA)


_RANGE = "doc_id bigint, text_hash int, start bigint, stop bigint"


def _suffix_ranges(sent: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Suffix order within a partition; byte ranges of suffixes with an earlier (or any other) partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, low = packets.unpack(batches, _SUFFIX, 6)
        wide = np.zeros((len(low), 8), dtype=np.uint8)
        wide[:, :6] = low
        value = wide.view(np.uint64).ravel()
        del low, wide
        # Entries, with their suffixes, by position: a stable sort by hash then leaves ties in position order.
        first = np.cumsum(entry["count"], dtype=np.int64) - entry["count"]
        order = _by_position(entry)
        entry, first = entry[order], first[order]
        n = entry["count"].astype(np.int64)
        owner = np.repeat(np.arange(len(entry)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        rank = mixed(entry["key"].copy())[owner] ^ value[first[owner] + within]
        suffixes = np.argsort(rank, kind="stable")
        ranked = rank[suffixes]
        same = ranked[1:] == ranked[:-1]
        previous, following = np.zeros(len(rank), dtype=bool), np.zeros(len(rank), dtype=bool)
        previous[suffixes[1:]] = same  # its previous smaller position is a match of the full length
        following[suffixes[:-1]] = same
        hit = np.flatnonzero(previous if keep_first else previous | following)
        at = entry["at"][owner[hit]] + within[hit]
        start, count = packets.runs(owner[hit], at - np.arange(len(hit))) if len(hit) else (hit, hit)
        rows, at = entry[owner[hit[start]]], at[start].astype(np.int64)
        yield pa.record_batch(
            [_nullable(rows["doc"].copy()), pa.array(rows["text"].copy()), pa.array(at), pa.array(at + count - 1 + length)],
            ["doc_id", "text_hash", "start", "stop"],
        )

    return sent.mapInArrow(run, _RANGE)


def repeated_ranges(documents: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """``doc_id, text_hash, start, stop``: byte ranges to remove; they may overlap and touch."""
    parts = max(8, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = stored(_met_runs(_send_runs(documents, length, parts).repartitionById(parts, F.col("part"))))
    copies = met.where("later" if keep_first else "repeated").select(
        "doc_id", "text_hash", F.col("at").cast("bigint").alias("start"), (F.col("at") + F.col("windows") - 1 + length).cast("bigint").alias("stop")
    )
    suffixes = _send_suffixes(documents, met, length, parts).repartitionById(parts, F.col("part"))
    return copies.unionByName(stored(_suffix_ranges(suffixes, length, keep_first)))


def _cut(text: str | None, starts: list[int], stops: list[int]) -> tuple[int, bytes, int, int]:
    """Bytes before, bytes kept, number removed, maximal removed runs."""
    data = (text or "").encode()
    if not starts:
        return len(data), data, 0, 0
    step = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, stops, -1)
    gone = np.cumsum(step)[:-1] > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return len(data), np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _with_ranges(documents: DataFrame, length: int, keep_first: bool) -> DataFrame:
    ranges = repeated_ranges(documents, length, keep_first).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("_ranges"))
    ranges = ranges.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    match = F.col("doc_id").eqNullSafe(F.col("_doc")) & (_text_hash(F.col("text")) == F.col("_hash"))
    return documents.join(ranges, match, "left").drop("_doc", "_hash").withColumns({"_starts": F.col("_ranges.start"), "_stops": F.col("_ranges.stop")}).drop("_ranges")


def repeat_digests(documents: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(t.as_py(), a.as_py() or [], b.as_py() or []) for t, a, b in zip(batch.column("text"), batch.column("_starts"), batch.column("_stops"), strict=True)]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    *[pa.array([c[k] for c in cut], pa.int64()) for k in (0, 2, 3)],
                    pa.array([hashlib.sha256(c[1]).hexdigest() for c in cut], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    ranged = _with_ranges(documents.select(F.col("doc_id").cast("bigint"), "text"), length, keep_first)
    return ranged.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(documents: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """``documents`` with ``kept`` (binary, as a cut may part a character), ``n_removed`` and ``n_spans``."""
    own = [c for c in documents.columns if c not in ("kept", "n_removed", "n_spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(t.as_py(), a.as_py() or [], b.as_py() or []) for t, a, b in zip(batch.column("text"), batch.column("_starts"), batch.column("_stops"), strict=True)]
            yield pa.record_batch(
                [*[batch.column(c) for c in own], pa.array([c[1] for c in cut], pa.binary()), pa.array([c[2] for c in cut], pa.int64()), pa.array([c[3] for c in cut], pa.int64())],
                [*own, "kept", "n_removed", "n_spans"],
            )

    added = [StructField("kept", BinaryType()), StructField("n_removed", LongType()), StructField("n_spans", LongType())]
    schema = StructType([*[f for f in documents.schema.fields if f.name in own], *added])
    return _with_ranges(documents.select(*[F.col(f"`{c}`") for c in own]), length, keep_first).mapInArrow(run, schema)
