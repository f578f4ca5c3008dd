"""Entries with their payload, packed into one row per target partition.

An entry is a record of a numpy dtype with a field ``count``; its payload is ``count`` items of a fixed width.
Packed rows shuffle at the bytes they hold, without a row header per item.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

SCHEMA = "part int, entries binary, payload binary"


def pack(entries: np.ndarray, payload: np.ndarray, part: np.ndarray, parts: int) -> pa.RecordBatch:
    """``payload``: uint8, one line per item, in the order of the entries. ``part``: of each entry."""
    item_part = np.repeat(part, entries["count"]) if len(payload) else np.zeros(0, np.int64)
    item_order, order = np.argsort(item_part, kind="stable"), np.argsort(part, kind="stable")
    items, entries = payload[item_order], entries[order]
    edges = np.arange(parts + 1)
    item_cut, cut = np.searchsorted(item_part[item_order], edges), np.searchsorted(part[order], edges)
    used = np.flatnonzero(np.diff(cut))
    return pa.record_batch(
        [
            pa.array(used.astype(np.int32)),
            pa.array([entries[cut[k] : cut[k + 1]].tobytes() for k in used], pa.binary()),
            pa.array([items[item_cut[k] : item_cut[k + 1]].tobytes() for k in used], pa.binary()),
        ],
        ["part", "entries", "payload"],
    )


def unpack(batches: Iterable[pa.RecordBatch], kind: np.dtype, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All entries and payload lines of a partition."""
    entries, payload = [], []
    for batch in batches:
        entries += [np.frombuffer(x.as_py(), kind) for x in batch.column("entries")]
        payload += [np.frombuffer(x.as_py(), np.uint8) for x in batch.column("payload")]
    if not entries:
        return np.zeros(0, kind), np.zeros((0, width), np.uint8)
    return np.concatenate(entries), np.concatenate(payload).reshape(-1, width)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs over which all columns stay equal."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, n))
