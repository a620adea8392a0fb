"""Word bounds in blocks of whole texts, found for all documents of a block at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from feedlake.llm.shared import utf8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# All bytes but ASCII letters, digits and the parts of longer characters
NO_WORD = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])


def spans(body: np.ndarray, lengths: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and document row of every word; ``blank`` flags places outside words."""
    if not len(body):
        return (np.zeros(0, np.int64),) * 3
    ends = np.cumsum(lengths)
    if blank is None:
        blank = NO_WORD[body]
    before, after = np.append(True, blank[:-1]), np.append(blank[1:], True)
    some = lengths > 0
    before[(ends - lengths)[some]] = True
    after[ends[some] - 1] = True
    first, last = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return first, last, np.searchsorted(ends, first, "right")


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a .. b of a batch with their text bytes and lengths, about ``most`` bytes at a time."""
    bounds, body = utf8(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        b = min(b, batch.num_rows)
        yield a, b, body[bounds[a] : bounds[b]], np.diff(bounds[a : b + 1])
        a = b
