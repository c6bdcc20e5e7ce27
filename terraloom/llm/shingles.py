"""Hashed word shingles of texts, a column at a time.

Words are the maximal runs without ASCII white space.  A batch's distinct words are
hashed once; numpy combines the hashes of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of all words of all texts, and each text's offsets."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    pieces = pc.ascii_split_whitespace(texts)
    flat, bounds = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    # lowered here, as Arrow's ascii_lower misreads slices of a cast column
    digest = np.fromiter(map(xxhash.xxh3_64_intdigest, map(bytes.lower, words) if lower else words), np.uint64, len(words))
    at = coded.indices.to_numpy(zero_copy_only=False)
    hashes = digest[at]
    if b"" in words:  # white space at a text's ends
        full = at != words.index(b"")
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        hashes = hashes[full]
    return hashes, bounds.astype(np.int64)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; the last positions lack some."""
    n = max(0, len(hashes) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h + hashes[i : i + n]) * PRIME
        h ^= h >> np.uint64(29)
    return mix(h)


def sets(column: pa.Array, size: int, lower: bool) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text.  A text of fewer words than ``size`` has
    its whole sequence as its one shingle; a text without words has none."""
    hashes, bounds = word_hashes(column, lower)
    all_windows = windows(hashes, size)
    at = bounds.tolist()
    for lo, hi in zip(at, at[1:]):
        if hi - lo >= size:
            yield np.unique(all_windows[lo : hi - size + 1])
        elif hi > lo:
            yield windows(hashes[lo:hi], hi - lo) ^ np.uint64(hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of about SLICE_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(group)], strict=True):
        yield batch.slice(lo, hi - lo)
