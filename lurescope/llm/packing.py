"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents become pieces of at most ``capacity`` tokens; a longer document gives a shorter first
piece and full ones after it. Pieces are placed by bulk-synchronous best fit, longest first:
each round takes the longest pieces left, finds for them the smallest gap that holds one
(successor sweep over the sorted gaps), places as many as there are such gaps - ranks settle
who gets which - and updates the gaps. Pieces and gaps of one length are alike, so a round works on
runs (length, ranks from-to); there are at most ``capacity`` lengths, whatever the corpus. The
plan is a table of runs, and each piece finds its sequence from its length and its
rank among the pieces of that length.

Ranks come from counts per (bucket, length): no task holds a length whole, and a third of all
rows of one length is spread over all buckets.

Defined cases: a null or empty text is the closing id alone, one piece of one token. Repeated
rows and repeated or null ids are packed one by one. An empty table gives no row. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lurescope.llm.handback import giving_back
from lurescope.session import stored

CAPACITY = 2048
CLOSING_ID = 0
LONG_RUN = 50_000
_BLANKS = re.compile(r"\s+")


class DocumentEncoder:
    """Ids of whole texts, without special tokens at the ends.

    The ids are those that ``tokenizers`` gives with ``vocabulary_path`` and its default settings: the string of an
    added token inside a text is that token. ``ranks_path`` holds the same vocabulary as ranks, which give the same ids
    (a test compares them) for a quarter of the time; texts that hold an added token's string, or a run of
    ``LONG_RUN`` white spaces, where ``tiktoken`` runs out of stack, go to ``tokenizers`` itself.
    """

    def __init__(self, ranks_path: str, pattern: str, vocabulary_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary_path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        odd = any(a in text for a in self.added) or (
            len(text) >= LONG_RUN and any(len(m[0]) >= LONG_RUN for m in _BLANKS.finditer(text))
        )
        ids = self.whole.encode(text, add_special_tokens=False).ids if odd else self.encoding.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


def public_encoder() -> DocumentEncoder:
    """The public byte-level vocabulary, where the installed package has it on this machine."""
    import public_tokenizers

    return DocumentEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def tokenized_pieces(documents: DataFrame, capacity: int = CAPACITY, encoder: Callable[[], DocumentEncoder] = public_encoder) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().ids
        closing = np.array([CLOSING_ID], dtype="<u4")
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, batch.column("text"), strict=True):
                data = memoryview(np.concatenate([encode(text.as_py()), closing]).tobytes())
                for k, (start, length) in enumerate(cut_pieces(len(data) // 4, capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(giving_back(run), schema)


def placement_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank + 1, first sequence, offset) that place every piece.

    ``counts`` has the number of pieces per length. Gaps are runs of sequences too, by free space.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first sequence, number)
    free: list[int] = []  # sorted free spaces that have gaps
    opened = 0

    def add(space: int, run: tuple[int, int]) -> None:
        if space <= 0:
            return
        if space not in gaps:
            gaps[space] = []
            bisect.insort(free, space)
        gaps[space].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                # No gap holds it. As many new sequences as the round needs when each takes its full share.
                share = capacity // length
                number = -(-left // share)
                full = left // share
                for k in range(share):
                    n = full if k >= left - full * share else number
                    if n:
                        plan.append((length, rank, rank + n, opened, k * length))
                        rank += n
                add(capacity - share * length, (opened, full))
                if number > full:
                    add(capacity - (left - full * share) * length, (opened + full, 1))
                opened += number
                left = 0
                continue
            space = free[at]
            first, number = gaps[space].pop()
            if not gaps[space]:
                del gaps[space]
                free.pop(at)
            n = min(number, left)
            plan.append((length, rank, rank + n, first, capacity - space))
            add(space - length, (first, n))
            if number > n:
                add(space, (first + n, number - n))
            rank, left = rank + n, left - n
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    n = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = stored(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n))))
    per_bucket = base.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_bucket.select("bucket", "length", before.alias("before"))
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = base.join(starts, ["bucket", "length"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    counts = {int(r["length"]): int(r["n"]) for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(placement_plan(counts, capacity), dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        by_length = {int(x): (a, b) for x, a, b in zip(*_groups(table[:, 0]), strict=True)}
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                a, b = by_length[int(x)]
                mine = length == x
                at[mine] = a + np.searchsorted(table[a:b, 1], rank[mine], side="right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.record_batch([*[batch.column(c) for c in names], pa.array(sequence), pa.array(table[at, 4])], [*names, "sequence_id", "offset"])

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select(*names, "rank").mapInArrow(giving_back(run), schema)


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first = np.unique(sorted_values, return_index=True)
    return values, first, np.append(first[1:], len(sorted_values))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, encoder: Callable[[], DocumentEncoder] = public_encoder) -> DataFrame:
    """Tokenize, cut and pack; one row per piece."""
    return pack(tokenized_pieces(documents, capacity, encoder), capacity)
