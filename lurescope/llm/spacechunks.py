"""Texts cut where one space stands between two characters that are no white space.

Splitters of byte-level and of piece vocabularies always begin a new unit at such a space, so the chunks of a
text can be tokenized one by one, and equal chunks have equal tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

WINDOW = 1 << 20
# Python's white space holds Unicode's, and four control characters more: fewer cuts, none wrong.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Whole chunks of ``size`` characters and more, so that a long text isn't split at once. They join to the text."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def chunks(window: str) -> list[str]:
    """The chunks of a window; all but the first without their leading space, so they join by spaces."""
    parts = window.split(" ")
    if all([p and not p[0].isspace() and not p[-1].isspace() for p in parts]):
        return parts
    found, open_chunk = [], [parts[0]]
    for left, right in zip(parts, parts[1:], strict=False):
        if left and right and not left[-1].isspace() and not right[0].isspace():
            found.append(" ".join(open_chunk))
            open_chunk = []
        open_chunk.append(right)
    return [*found, " ".join(open_chunk)]
