"""Byte-level BPE encoding and decoding with a vocabulary of ranks.

A text is split by the vocabulary's pattern and every match is encoded on its own. A match is a
row of byte positions; the rank of a position is the rank of the token that its part and the next
live part make together (none: infinite). A segment tree over the positions keeps in every node
the leftmost position of the least rank, so the root names the next merge. A merge joins two
neighbours: the right one dies, and only the ranks of the merged part and of the part before it
change, so it costs three point updates of logarithmic length. A match of n bytes takes
O(n log n), whatever its bytes, where the plain search for the least rank takes O(n^2).

Equal matches have equal ids, so each worker keeps those of short matches, over all its tasks, in a bounded store
(``KEPT``, emptied when full); matches of more than ``SHORT`` characters are encoded anew. Long texts are
matched window by window, cut at single spaces, where every match of such a pattern begins anew
(``spacechunks``; a pattern without that property is declared with ``spaces_begin=False``). All work is a
projection of its row: nothing is shuffled, and a lost executor repeats its own rows only.

Ids are binary columns of little-endian unsigned 32-bit integers.

Defined cases: a null or empty text has no ids, and its bytes are empty. Repeated rows, null and
repeated ids are encoded row by row. An empty table gives no row. Other columns, whatever their
names, are carried through. Decoding an id that isn't in the vocabulary is an error, as is a
byte string whose length is no multiple of four; null ids are decoded to no bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lurescope.llm.spacechunks import windows

SHORT = 64
KEPT = 400_000
SLICE = 50_000
_NONE = 1 << 62  # above every rank and place


def merged_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merges of the leftmost pair of least rank until no pair is a token."""
    if piece in ranks:
        return [ranks[piece]]
    n, get = len(piece), ranks.get
    leaves = 1 << (n - 1).bit_length()
    # A leaf: rank of the part that starts here with the next one, and its place; the least is the leftmost of least rank.
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank * leaves + i
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = right if right < left else left
    after = list(range(1, n + 1))  # start of the next live part
    before = list(range(-1, n - 1))

    def update(at: int, end: int) -> None:
        """The part at ``at`` pairs up to ``end`` now (0: with nothing). Nodes above one that stays as it was stay as well."""
        rank = get(piece[at:end]) if end else None
        value = _NONE if rank is None else rank * leaves + at
        node = at + leaves
        while tree[node] != value:
            tree[node] = value
            if node == 1:
                return
            other = tree[node ^ 1]
            value = other if other < value else value
            node >>= 1

    while tree[1] < _NONE:
        at = tree[1] & (leaves - 1)
        gone = after[at]
        end = after[at] = after[gone]
        update(gone, 0)
        if end < n:
            before[end] = at
            update(at, after[end])
        else:
            update(at, 0)
        if before[at] >= 0:
            update(before[at], end)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class _Store(dict):
    """Packed ids of matches; what is missing is merged, and kept if it is short."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, match: str) -> bytes:
        merged = merged_ids(match.encode(), self.ranks)
        ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(match) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[match] = ids
        return ids


class BytePairs:
    """A vocabulary of ranks (bytes -> id) with its pattern; encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaces_begin: bool = True):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.spaces_begin = spaces_begin
        self.tokens = {i: token for token, i in ranks.items()}
        self.kept = _Store(ranks)

    @staticmethod
    def load(path: str, pattern: str, spaces_begin: bool = True) -> BytePairs:
        """From a file of base64 tokens with their ranks."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        return BytePairs(ranks, pattern, spaces_begin)

    def encode(self, text: str | None) -> bytes:
        """The packed ids of a text."""
        if not text:
            return b""
        parts = windows(text) if self.spaces_begin else [text]
        ids = self.kept.__getitem__
        return b"".join([b"".join(map(ids, self.find(part))) for part in parts])

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that packed ids stand for."""
        numbers, tokens, slices = np.frombuffer(ids or b"", dtype="<u4"), self.tokens, []
        for first in range(0, len(numbers), SLICE):
            slices.append(b"".join(map(tokens.__getitem__, numbers[first : first + SLICE].tolist())))
        return b"".join(slices)


@cache
def public_pairs() -> BytePairs:
    """The public byte-level vocabulary, where the installed package has it on this machine.

    A worker process keeps it and its store of matches from task to task.
    """
    import public_tokenizers

    return BytePairs.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _with_binary(df: DataFrame, source: str, target: str, work: Callable[[], Callable]) -> DataFrame:
    """``df`` with the binary column ``target``, made value by value from ``source``."""
    kept = [c for c in df.columns if c != target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            values = pa.array([function(x.as_py()) for x in batch.column("_source")], pa.binary())
            yield pa.record_batch([*[batch.column(c) for c in kept], values], [*kept, target])

    fields = [f for f in df.schema.fields if f.name != target]
    return df.select(*kept, F.col(source).alias("_source")).mapInArrow(run, StructType([*fields, StructField(target, BinaryType())]))


def encode_texts(df: DataFrame, vocabulary: Callable[[], BytePairs] = public_pairs, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the packed ids of ``text`` in the binary column ``ids``."""
    return _with_binary(df, text, ids, lambda: vocabulary().encode)


def decode_ids(df: DataFrame, vocabulary: Callable[[], BytePairs] = public_pairs, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the packed ``ids`` stand for in the binary column ``decoded``."""
    return _with_binary(df, ids, decoded, lambda: vocabulary().decode)


def digests(documents: DataFrame, vocabulary: Callable[[], BytePairs] = public_pairs) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded from the ids."""
    both = decode_ids(encode_texts(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), vocabulary).drop("text"), vocabulary)
    return both.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
