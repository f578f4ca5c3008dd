"""Tokens of two tokenizers, A (byte-level) and B (pieces), aligned by the bytes they cover.

A encodes a space and the text, B the text, to which it adds that space itself. Where tokens end is read off
spans first: the character offsets that ``tokenizers`` gives for A and ``sentencepiece`` for B are coarse cuts,
right wherever a token ends between two characters. Tokens that split a character, and byte-fallback tokens,
share a span; their ends inside it come from the bytes they decode to. Places where an A and a B
token both end cut both into groups; between neighbouring ends of either side lies exactly one pair of
overlapping tokens, a link.

Both tokenizers begin anew at a single space (``spacechunks``), so a text's tokens are those of its chunks. Inside a chunk they
begin anew where plain letters and digits meet marks (``_INNER``), so a short chunk's tokens are those of its units, and a word
is aligned once whatever marks follow it. Whether the pieces allow either is read off B's vocabulary; without that, chunks or
whole texts are encoded as they are. A worker process keeps a bounded store (``KEPT``) of aligned units from task to task; units
that it lacks are encoded together, in texts of about ``ENCODED`` characters, as both libraries take more time for a long one.

Corpus counts: a pair's count is the number of rows that hold it linked. Each task counts its own rows' pairs first;
counts go to partitions by A's id, where they are summed and the highest of each id is found. The most
frequent pairs (``SHARED`` at most, so a fixed number of bytes) are broadcast, and rows find them in place. The rest
meet their rows by A's id in partitions of bounded size: a pair that many rows hold is among the broadcast ones,
so no partition gets a third of all rows.

Defined cases: a row whose text is null or empty, or whose joined A or B bytes differ from space+text (B reads
U+2581 as a space), has no tokens: all numbers are zero, the digest is ''. Repeated rows and null or repeated ids
are rows of their own, also in the counts. An empty table gives no row. Extra columns are ignored. Every
text is read whole; a lost executor repeats its own partitions.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.packets import SCHEMA, pack, unpack
from lurescope.llm.spacechunks import chunks, windows
from lurescope.llm.textblocks import mixed
from lurescope.session import stored

KEPT = 700_000
SHORT = 100
TOGETHER = 1 << 20
ENCODED = 1 << 13
SHARED = 2_000_000
PER_PART = 1_000_000
BATCH = 500
SLICE = 50_000
_U4 = np.dtype("<u4")
# Latin letters and digits meet ASCII marks or line feeds. A's splitter ends a unit there, save in ``'s`` and its like; a unit
# may end with one line feed, but not with more, which A splits by what is behind them.
_PLAIN, _MARK = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~"
_INNER = re.compile(f"(?<=[{_PLAIN}])(?=[\\n{_MARK}])|(?:(?<=[{_MARK}])(?<!')|(?<=\\S\\n))(?=[{_PLAIN}])")


class Aligned(NamedTuple):
    """One unit of a chunk, or a chunk: the digest's text, its links as packed pairs, sizes, and packed ids and byte lengths of both sides."""

    groups: str
    links: bytes  # little-endian unsigned 64-bit: A's id above B's
    n_groups: int
    n_a: int
    n_b: int
    sides: tuple[bytes, bytes, bytes, bytes] | None


def token_ends(spans: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from their character spans (one line each), refined by the bytes they decode to.

    ``sizes``: decoded bytes of each token; ``before``: bytes before each character, with the whole behind. A token that
    ends where the next one begins ends between two characters, and the bytes up to there are known; tokens that overlap
    or share an end split a character, and their ends follow from the last known end and the bytes since.
    """
    n = len(spans)
    if not n:
        return np.zeros(0, np.int64)
    end = spans[:, 1]
    split = np.zeros(n, dtype=bool)
    split[:-1] = (spans[1:, 0] < end[:-1]) | (end[1:] <= end[:-1])
    split[1:] |= end[1:] <= end[:-1]
    known = np.maximum.accumulate(np.where(split, -1, np.arange(n)))
    total = np.cumsum(sizes)
    base = np.where(known >= 0, before[end[known]] - total[known], 0)
    return total + base


class Tokenizers:
    """A and B with the bytes of their tokens."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True  # their strings inside a text are text
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: Every id (B's after A's) as it is written before another of its side, before ``|`` and before ``;``.
        ids = [*map(str, range(len(self.a_bytes))), *map(str, range(len(self.b_bytes)))]
        self.written = [i + mark for mark in ",|;" for i in ids]
        self.written_sizes = np.array([len(w) for w in self.written], np.int64)
        #: No piece goes on over a space after another character, so no piece leaves its chunk.
        self.b_begins_at_spaces = all("▁" not in p.lstrip("▁") for p in pieces)
        own = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: No piece goes on over a change between plain characters and marks, so no piece leaves its unit.
        self.b_begins_at_marks = self.b_begins_at_spaces and not any(_INNER.search(p) for p in own)

    def units(self, chunk: str) -> list[str]:
        """The parts of a chunk whose tokens don't depend on what is around them. Only the first one has the space in front."""
        return _INNER.split(chunk) if self.b_begins_at_marks else [chunk]

    def align(self, parts: list[str], sides: bool = False, begins: list[bool] | None = None) -> list[Aligned | None]:
        """Alignment of units, which are encoded together as one text; None where a side's bytes aren't those of space+chunk.

        ``begins``: which units begin a chunk, after a space; the others go on. Without it, all do.
        """
        spaced = " " + " ".join(parts) if begins is None else "".join([" " + p if new else p for p, new in zip(parts, begins, strict=True)])
        text, raw = spaced[1:], spaced.encode()
        a_side = self.a.encode(spaced, add_special_tokens=False)
        b_side = self.b.encode_as_offset_mapping(text)
        a_ids, b_ids = a_side.ids, b_side["ids"]
        if b"".join([self.a_bytes[i] for i in a_ids]) != raw or b"".join([self.b_bytes[i] for i in b_ids]) != raw:
            first = range(len(parts)) if begins is None else np.flatnonzero(begins).tolist()
            if len(first) == 1:
                return [None] * len(parts)
            half = first[len(first) // 2]
            left, right = (None, None) if begins is None else (begins[:half], begins[half:])
            return self.align(parts[:half], sides, left) + self.align(parts[half:], sides, right)
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        code = np.frombuffer(spaced.encode("utf-32-le"), "<u4")
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        before = np.concatenate(([0], np.cumsum(width)))
        a_ends = token_ends(_lines(a_side.offsets), self.a_sizes[a], before)
        # B's spans are those of the text, so one character is missing in front.
        b_ends = token_ends(_lines(b_side["offsets"]) + 1, self.b_sizes[b], before)
        both = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")  # two rising runs, merged
        again = both[1:] == both[:-1]
        ends, cuts = both[np.concatenate(([True], ~again))], both[1:][again]
        links = (a[np.searchsorted(a_ends, ends)] << 32) | b[np.searchsorted(b_ends, ends)]
        a_cut, b_cut = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        groups, group_ends = self._group_texts(a, a_cut, b, b_cut)

        sizes = [len(p) if p.isascii() else len(p.encode()) for p in parts]
        at = np.cumsum(sizes) + (np.arange(1, len(parts) + 1) if begins is None else np.cumsum(begins))
        place = np.minimum(np.searchsorted(cuts, at), len(cuts) - 1)
        if (cuts[place] != at).any():
            raise ValueError("a token goes on over a single space or a mark")
        n_links, n_a, n_b = (np.diff(x, prepend=0).tolist() for x in (np.searchsorted(ends, at) + 1, a_cut[place], b_cut[place]))
        n_groups, texts = np.diff(place + 1, prepend=0).tolist(), group_ends[place].tolist()
        packed = links.astype("<u8").tobytes()
        whole = [v.astype(_U4).tobytes() for v in (a, np.diff(a_ends, prepend=0), b, np.diff(b_ends, prepend=0))] if sides else None
        found, g, k, x, y = [], 0, 0, 0, 0
        for end, count, linked, in_a, in_b in zip(texts, n_groups, n_links, n_a, n_b, strict=True):
            own = None
            if whole is not None:
                a_part, b_part = slice(4 * x, 4 * (x + in_a)), slice(4 * y, 4 * (y + in_b))
                own = (whole[0][a_part], whole[1][a_part], whole[2][b_part], whole[3][b_part])
            found.append(Aligned(groups[g : end - 1], packed[8 * k : 8 * (k + linked)], count, in_a, in_b, own))
            g, k, x, y = end, k + linked, x + in_a, y + in_b
        return found

    def _group_texts(self, a: np.ndarray, a_cut: np.ndarray, b: np.ndarray, b_cut: np.ndarray) -> tuple[str, np.ndarray]:
        """``a1,a2|b1;`` of every group, joined, and where each ends; the cuts are the number of tokens up to each group's end."""
        n = len(self.a_bytes) + len(self.b_bytes)
        a_kind, b_kind = a.copy(), b + len(self.a_bytes)
        a_kind[a_cut - 1] += n
        b_kind[b_cut - 1] += 2 * n
        # A's tokens stand after B's of all groups before, B's after A's up to their own group.
        a_group, b_group = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
        kinds = np.empty(len(a) + len(b), np.int64)
        kinds[np.arange(len(a)) + np.repeat(b_cut - b_group, a_group)] = a_kind
        kinds[np.arange(len(b)) + np.repeat(a_cut, b_group)] = b_kind
        written = self.written
        return "".join([written[i] for i in kinds.tolist()]), np.cumsum(self.written_sizes[kinds])[a_cut + b_cut - 1]


def _lines(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


def _byte_letters() -> dict[str, int]:
    """The published rule of byte-level vocabularies: printable bytes stand for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def public_tokenizers_pair() -> Tokenizers:
    """The public vocabularies, where the installed package has them on this machine."""
    import public_tokenizers

    return Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


class _Aligner:
    """Whole texts by chunks, with a bounded store of units: by themselves the first of a chunk, in a tuple those without a space in front."""

    def __init__(self, tokenizers: Tokenizers, sides: bool):
        self.tokenizers, self.sides = tokenizers, sides
        self.kept: tuple[dict[str | tuple[str], Aligned | None], ...] = ({}, {})
        self.joined: dict[str, Aligned | None] = {}  # chunks of several units, a fifth of all that is kept

    def texts(self, texts: list[str | None]) -> list[list[Aligned] | None]:
        """The chunks of each text; None where it has no tokens."""
        at_spaces = self.tokenizers.b_begins_at_spaces
        found: list[list[Aligned] | None] = []
        for first, end in _byte_slices(texts, TOGETHER):
            if end - first > 1 or not at_spaces:
                parts = [[] if not t else chunks(t) if at_spaces else [t] for t in texts[first:end]]
                table = self._table(set().union(*parts))
                found += [[*map(table.__getitem__, own)] for own in parts]
            else:  # may be very long: only one window's chunks are there at a time
                own = []
                for k, window in enumerate(windows(texts[first] or "")):
                    parts = chunks(window[1:] if k else window) if window else []
                    own += map(self._table(set(parts)).__getitem__, parts)
                found.append(own)
        return [None if not own or any([x is None for x in own]) else own for own in found]

    def _table(self, wanted: set[str]) -> dict[str, Aligned | None]:
        """The wanted chunks. Two generations are kept: a full younger one takes the place of the older."""
        young, old = self.kept
        new = wanted.difference(young)
        table: dict[str, Aligned | None] = {p: young[p] for p in wanted.difference(new)}
        fresh: dict[str | tuple[str], Aligned | None] = {}  # units that the younger one lacks
        edged, missing, several = [], [], []
        alone = not self.tokenizers.b_begins_at_spaces
        for p in new:
            if p in old:
                fresh[p] = old[p]
            elif p in self.joined:
                table[p] = self.joined[p]
            elif "▁" in p:  # B reads that character as a space
                fresh[p] = None
            elif alone or p != p.strip():  # a text's first or last; no other may follow its white space
                edged.append([p])
            elif len(p) > SHORT or p.isalnum() or len(units := self.tokenizers.units(p)) == 1:  # long ones would be millions of units
                missing.append(p)
            else:
                several.append((p, units, [(u,) for u in units[1:]]))
        waiting = several
        while edged or missing or waiting:  # a second time only for units of a chunk without tokens
            claimed, inside = {*missing}, []
            for chunk in waiting:
                first, later = chunk[1][0], chunk[2]
                if lacking := [k for k in later if k not in young and k not in fresh and k not in claimed]:
                    fresh.update([(k, old[k]) for k in lacking if k in old])
                    if lacking := [k for k in lacking if k not in old]:
                        inside.append(chunk)
                        claimed.update(lacking)
                if first not in young and first not in fresh and first not in claimed:
                    if first in old:
                        fresh[first] = old[first]
                    else:
                        missing.append(first)
                        claimed.add(first)
            missing.sort()  # both libraries are faster where neighbours begin alike
            for own in [*edged, *(missing[i:j] for i, j in _byte_slices(missing, ENCODED))]:
                fresh.update(zip(own, self.tokenizers.align(own, self.sides), strict=True))
            for i, j in _byte_slices([p for p, _, _ in inside], ENCODED):
                parts, begins = [u for _, units, _ in inside[i:j] for u in units], [k == 0 for _, units, _ in inside[i:j] for k in range(len(units))]
                found = iter(self.tokenizers.align(parts, self.sides, begins))
                for p, _, later in inside[i:j]:
                    first, *rest = [next(found) for _ in range(len(later) + 1)]
                    if first is None:
                        table[p] = None
                    else:
                        fresh.update(zip(later, rest, strict=True))
            edged, missing = [], []
            waiting = [x for x in waiting if x[0] not in table and any([k not in fresh and k not in young for k in x[2]])]
        for p in new.intersection(fresh):
            table[p] = fresh[p]
        for p, units, later in several:
            if p not in table:
                table[p] = x = _joined([fresh[k] if k in fresh else young[k] for k in (units[0], *later)])
                if len(self.joined) < KEPT // 5:
                    self.joined[p] = x
        if len(self.joined) >= KEPT // 5:
            self.joined = {}
        for k, x in fresh.items():
            if len(young) >= 2 * KEPT // 5:
                young, old = {}, young
            if len(k if isinstance(k, str) else k[0]) <= SHORT:
                young[k] = x
        self.kept = (young, old)
        return table


def _joined(units: list[Aligned | None]) -> Aligned | None:
    """A chunk from its units; None where one has no tokens."""
    if None in units:
        return None
    if len(units) == 2 and units[0].sides is None:
        x, y = units
        return Aligned(x.groups + ";" + y.groups, x.links + y.links, x.n_groups + y.n_groups, x.n_a + y.n_a, x.n_b + y.n_b, None)
    groups, links, n_groups, n_a, n_b, sides = zip(*units, strict=True)
    own = None if sides[0] is None else tuple(map(b"".join, zip(*sides, strict=True)))
    return Aligned(";".join(groups), b"".join(links), sum(n_groups), sum(n_a), sum(n_b), own)


@lru_cache(maxsize=1)
def _worker_aligner(tokenizers: Callable[[], Tokenizers], sides: bool) -> _Aligner:
    """A worker process keeps its aligner, with its store, from task to task."""
    return _Aligner(tokenizers(), sides)


def _byte_slices(texts: list[str | None], size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters together; a longer one is alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and held + n > size:
            yield first, i
            first, held = i, 0
        held += n
    if texts:
        yield first, len(texts)


def align_tokens(documents: DataFrame, tokenizers: Callable[[], Tokenizers] = public_tokenizers_pair, spans: bool = True) -> DataFrame:
    """One row per document with its aligned tokens.

    ``doc_id``; with ``spans`` ``a_ids, a_lengths, b_ids, b_lengths`` (binary, little-endian unsigned 32-bit: ids and the
    number of bytes each token covers of space+text, in order; ends are their running sums); ``n_a, n_b, n_groups, n_links``; ``groups_sha256`` of the groups
    ``a1,a2|b1;a3|b2,b3``; ``pairs, times`` (binary: the linked id pairs, A's id above B's in 64 bits, in order, and how often each).
    """
    sides = ["a_ids", "a_lengths", "b_ids", "b_lengths"] if spans else []
    numbers, binary = ["n_a", "n_b", "n_groups", "n_links"], ["pairs", "times"]
    names = ["doc_id", *sides, *numbers, "groups_sha256", *binary]
    types = [*[pa.binary()] * len(sides), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
    nothing = (*[b""] * len(sides), 0, 0, 0, 0, "", b"", b"")

    def values(found: list[Aligned]) -> tuple:
        digest = hashlib.sha256()
        for first in range(0, len(found), SLICE):
            digest.update((";" if first else "").encode() + ";".join([x.groups for x in found[first : first + SLICE]]).encode())
        links = np.frombuffer(b"".join([x.links for x in found]), "<u8")
        pairs, times = np.unique(links, return_counts=True)
        n_a, n_b = sum([x.n_a for x in found]), sum([x.n_b for x in found])
        covered = [b"".join([x.sides[k] for x in found]) for k in range(len(sides))]
        n_groups = sum([x.n_groups for x in found])
        return (*covered, n_a, n_b, n_groups, len(links), digest.hexdigest(), pairs.tobytes(), times.astype(_U4).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker_aligner(tokenizers, spans)
        for batch in batches:
            for first in range(0, len(batch), BATCH):
                part = batch.slice(first, BATCH)
                gc.disable()  # millions of spans would set it off time and again; none is in a cycle
                try:
                    found = aligner.texts(part.column("text").to_pylist())
                    rows = [nothing if f is None else values(f) for f in found]
                finally:
                    gc.enable()
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.record_batch([part.column("doc_id"), *columns], names)

    schema = ", ".join(
        ["doc_id bigint", *[f"{c} binary" for c in sides], *[f"{c} bigint" for c in numbers], "groups_sha256 string", *[f"{c} binary" for c in binary]]
    )
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


_COUNT = np.dtype([("pair", "<u8"), ("n", "<i8"), ("best", "?"), ("count", "<i4")])  # ``count``: payload items, none


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(n, first) if len(pairs) else n


def _part(pairs: np.ndarray, parts: int) -> np.ndarray:
    """Partition by A's id."""
    return (mixed(pairs >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _packed(pairs: np.ndarray, n: np.ndarray, best: np.ndarray | None, part: np.ndarray, parts: int) -> pa.RecordBatch:
    entries = np.zeros(len(pairs), _COUNT)
    entries["pair"], entries["n"] = pairs, n
    if best is not None:
        entries["best"] = best
    return pack(entries, np.zeros((0, 1), np.uint8), part, parts)


def pair_counts(rows: DataFrame, parts: int) -> DataFrame:
    """(part, entries, payload): packed pairs with the number of rows that hold each, and whether it is its A id's highest.

    ``rows`` has the binary column ``pairs``. One packed row per partition, which holds whole A ids.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            new = np.frombuffer(b"".join(x.as_py() for x in batch.column("pairs")), "<u8")
            held, n = _summed(np.concatenate((held, new)), np.concatenate((n, np.ones(len(new), np.int64))))
            if len(held) > SHARED:  # memory stays bounded; the rest is summed after the shuffle
                yield _packed(held, n, None, _part(held, parts), parts)
                held, n = held[:0], n[:0]
        yield _packed(held, n, None, _part(held, parts), parts)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, _ = unpack(batches, _COUNT, 1)
        if len(entries):
            pairs, n = _summed(entries["pair"], entries["n"])
            a = pairs >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            highest = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(a))))
            yield _packed(pairs, n, n == highest, _part(pairs, parts), parts)

    return rows.select("pairs").mapInArrow(count, SCHEMA).repartition(parts, "part").mapInArrow(total, SCHEMA)


def _frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, int, int]:
    """(the most frequent pairs sorted by pair, the least count among them, number of all pairs).

    Bounded: whole classes of counts (by powers of two) from the top while they hold at most ``limit`` pairs.
    """

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, _ = unpack(batches, _COUNT, 1)
        size = np.bincount(np.log2(entries["n"]).astype(np.int64), minlength=1) if len(entries) else np.zeros(0, np.int64)
        used = np.flatnonzero(size)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(size[used], pa.int64())], ["class", "n"])

    sizes = counts.mapInArrow(classes, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n"))
    sizes = {r["class"]: r["n"] for r in sizes.collect()}
    least, held = 0, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > limit:
            least = 1 << (k + 1)
            break

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = np.concatenate([np.zeros(0, _COUNT), *[np.frombuffer(x.as_py(), _COUNT) for x in batch.column("entries")]])
            yield pa.record_batch([pa.array([entries[entries["n"] >= least].tobytes()], pa.binary())], ["entries"])

    found = [np.frombuffer(r["entries"], _COUNT) for r in counts.mapInArrow(chosen, "entries binary").toLocalIterator()]
    frequent = np.concatenate([np.zeros(0, _COUNT), *found])
    return frequent[np.argsort(frequent["pair"])], least, sum(sizes.values())


_HELD = np.dtype([("pair", "<u8"), ("node", "<i8"), ("n", "<i8"), ("kind", "u1"), ("best", "?"), ("count", "<i4")])


def with_link_counts(rows: DataFrame, shared_limit: int = SHARED, per_part: int = PER_PART) -> DataFrame:
    """``rows`` (of :func:`align_tokens`, stored) with ``n_best`` and ``count_sum``; ``pairs`` and ``times`` go."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = stored(pair_counts(rows, parts))
    frequent, least, total = _frequent(counts, shared_limit)
    table = spark.sparkContext.broadcast((frequent["pair"].copy(), frequent["n"].copy(), frequent["best"].copy()))
    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    named = stored(rows.withColumn("_node", F.monotonically_increasing_id())) if len(frequent) < total else rows.withColumn("_node", F.lit(0).cast("bigint"))

    def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Row, pair and number of links of a batch, and the place of each pair in the shared table."""
        cells = [np.frombuffer(x.as_py(), "<u8") for x in batch.column("pairs")]
        row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        pair = np.concatenate([np.zeros(0, np.uint64), *cells])
        times = np.frombuffer(b"".join(x.as_py() for x in batch.column("times")), _U4).astype(np.int64)
        at = np.searchsorted(table.value[0], pair)
        there = at < len(table.value[0])
        there[there] = table.value[0][at[there]] == pair[there]
        return row, pair, times, at, there

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, times, at, there = looked_up(batch)
            best, summed = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(best, row[there], times[there] * table.value[2][at[there]])
            np.add.at(summed, row[there], times[there] * table.value[1][at[there]])
            yield pa.record_batch([*[batch.column(c) for c in (*kept, "_node")], pa.array(best), pa.array(summed)], [*kept, "_node", "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields if f.name in kept)
    first = named.select(*kept, "_node", "pairs", "times").mapInArrow(known, schema + ", _node bigint, n_best bigint, count_sum bigint")
    if len(frequent) == total:
        return first.drop("_node")

    many = max(parts, -(-int(rows.agg(F.sum(F.octet_length("pairs"))).first()[0] or 0) // (8 * per_part)))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pair, times, _, there = looked_up(batch)
            entries = np.zeros(int((~there).sum()), _HELD)
            entries["pair"], entries["n"], entries["node"] = pair[~there], times[~there], np.asarray(batch.column("_node"))[row[~there]]
            yield pack(entries, np.zeros((0, 1), np.uint8), _part(entries["pair"], many), many)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("entries"):
                c = np.frombuffer(cell.as_py(), _COUNT)
                c = c[c["n"] < least]
                entries = np.zeros(len(c), _HELD)
                entries["pair"], entries["n"], entries["best"], entries["kind"] = c["pair"], c["n"], c["best"], 1
                yield pack(entries, np.zeros((0, 1), np.uint8), _part(entries["pair"], many), many)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, _ = unpack(batches, _HELD, 1)
        have, want = entries[entries["kind"] == 1], entries[entries["kind"] == 0]
        have = have[np.argsort(have["pair"])]
        at = np.searchsorted(have["pair"], want["pair"])
        links, count = want["n"], have["n"][at]
        nodes, place = np.unique(want["node"], return_inverse=True)
        best, summed = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        np.add.at(best, place, links * have["best"][at])
        np.add.at(summed, place, links * count)
        yield pa.record_batch([pa.array(nodes), pa.array(best), pa.array(summed)], ["_node", "b", "s"])

    both = named.select("_node", "pairs", "times").mapInArrow(rare, SCHEMA).unionByName(counts.mapInArrow(counted, SCHEMA))
    rest = both.repartition(many, "part").mapInArrow(met, "_node bigint, b bigint, s bigint")
    rest = rest.groupBy("_node").agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
    joined = first.join(rest, "_node", "left")
    return joined.select(
        *kept, (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum")
    )


def alignment_digests(documents: DataFrame, tokenizers: Callable[[], Tokenizers] = public_tokenizers_pair, shared_limit: int = SHARED) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    rows = stored(align_tokens(documents, tokenizers, spans=False))
    counted = with_link_counts(rows, shared_limit)
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
