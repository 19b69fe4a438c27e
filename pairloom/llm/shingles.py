"""Word shingles of texts and their hashes, vectorised over Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SEED = 42
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_bounds(texts: pa.Array, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words joined by single spaces, starts and ends of all shingles, offsets by text); A-Z are lower-cased."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    blank = np.ones(len(data) + len(texts) + 1, bool)  # a blank after each text, and one before all
    laid = np.full(len(blank), 32, np.uint8)
    at = 1 + np.arange(len(data)) + np.repeat(np.arange(len(texts)), np.diff(offsets))
    blank[at], laid[at] = _BLANK[data], _LOWER[data]
    kept = ~blank
    kept[1:] |= ~blank[:-1]  # the first blank after a word
    laid[blank] = 32
    position = np.cumsum(kept) - 1  # of kept bytes
    starts = position[1:][~blank[1:] & blank[:-1]]
    ends = position[1:][blank[1:] & ~blank[:-1]]
    word_ends = np.concatenate([[0], np.cumsum(~blank[1:] & blank[:-1])])  # words begun before each byte
    words = word_ends[offsets + np.arange(len(texts) + 1)]
    counts = np.diff(words)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.repeat(words[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = first + np.repeat(np.minimum(counts, width), n) - 1
    return laid[kept].tobytes(), starts[first], ends[last], np.concatenate([[0], np.cumsum(n)])


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the eight bytes of each shingle's hash, the first byte first; offsets by text)."""
    data, starts, ends, offsets = shingle_bounds(texts, width)
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(data[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(joined, np.uint8).reshape(-1, 8), offsets


def majority_bits(hashes: np.ndarray) -> np.uint64:
    """The fingerprint of hashes (eight bytes each): the bits that more than half of them have; of no hashes 0."""
    if not len(hashes):
        return np.uint64(0)
    sums = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * sums > len(hashes)).view(">u8")[0]


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, offsets = shingle_hashes(texts, width)
    plain = hashes.view(">u8").ravel().astype(np.uint64)
    return [np.unique(plain[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
