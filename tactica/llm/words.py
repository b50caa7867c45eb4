"""Words of whole Arrow batches by numpy: ASCII letters and digits and everything outside ASCII, A-Z lowered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Every byte as it stands in a word; bytes outside words are spaces.
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)], np.uint8)
SPACE = 32


def portions(batch: pa.RecordBatch, text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold ``most`` bytes at most; a longer text stands alone."""
    offsets, first = _offsets(batch[text_col]), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


@dataclass
class Words:
    """The words of some texts in order.

    ``line`` holds their bytes; between two words of one text stands one space, so that a run of
    words is a slice. ``start`` and ``length`` are a word's place there, ``doc`` is its text, ``code``
    its number among ``distinct``, the different words by first appearance.
    """

    line: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    distinct: pa.Array
    n_docs: int

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=self.n_docs)


def split(texts: pa.Array) -> Words:
    """``texts`` without nulls, split into words."""
    offsets, n = _offsets(texts), len(texts)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    low = LOWERED[data]
    inside = low != SPACE
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(low))]  # a word ends with its text
    opens[edges] |= inside[edges]
    closes[edges - 1] |= inside[edges - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    length = last + 1 - first
    doc = np.searchsorted(bounds, first, "right") - 1
    # one space after every word that another of the same text follows
    gap = np.zeros(len(first), bool)
    gap[:-1] = doc[1:] == doc[:-1]
    kept = inside.copy()
    kept[last[gap] + 1] = True
    line = low[kept]
    ends = np.cumsum(length)
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(low[inside])])
    coded = packed.dictionary_encode()
    return Words(line, np.cumsum(length + gap) - (length + gap), length, doc, coded.indices.to_numpy(), coded.dictionary, n)
