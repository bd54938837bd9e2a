"""Words of letters, digits and everything beyond ASCII, A-Z lower-cased, cut by numpy.

A whole Arrow column is cut at once: one table lookup per byte, then the places where word
bytes begin and end. Offsets refer to the original text, as folding keeps every byte's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once; a single longer text is cut alone.
CUT_BYTES = 2_000_000

#: Word bytes to their lower-case form, all others to zero.
_FOLD = np.zeros(256, dtype=np.uint8)
for _byte in (*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)):
    _FOLD[_byte] = _byte
for _byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_byte] = _byte + 32


@dataclass(frozen=True)
class Words:
    """All words of several texts, in order."""

    #: The folded words.
    words: pa.LargeBinaryArray
    #: Words before each text, and of all texts at the end.
    bounds: np.ndarray
    #: Byte offsets of each word in its own text.
    starts: np.ndarray
    ends: np.ndarray


def cut(texts: pa.Array) -> Words:
    """Words of each text of an Arrow string column; null and empty texts have none."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    size = int(offsets[-1] - offsets[0]) if len(texts) else 0
    if not size:
        empty = np.zeros(0, dtype=np.int64)
        return Words(pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, dtype=np.int64), empty, empty)
    base = offsets - offsets[0]
    folded = _FOLD[np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]]
    inside = folded != 0
    before = np.empty(size, dtype=bool)  # whether the byte before belongs to the same text and a word
    before[0] = False
    before[1:] = inside[:-1]
    first = base[:-1][base[:-1] < size]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(size, dtype=bool)
    after[:-1] = before[1:] & inside[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(folded[inside])]
    )
    bounds = np.searchsorted(starts, base)
    own = np.repeat(base[:-1], np.diff(bounds))
    return Words(words, bounds, starts - own, ends - own)


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together hold at most ``CUT_BYTES``, one row at least."""
    column = batch.column(text).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + CUT_BYTES, side="right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto
