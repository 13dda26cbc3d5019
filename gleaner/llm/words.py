"""Word shingles as 64-bit fingerprints, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads near ones."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def encoded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, A-Z lower-cased; the place among them of each word of all texts in a
    row; and each text's offsets."""
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = pc.ascii_split_whitespace(lowered)
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.dictionary_encode(words.flatten())
    distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()
    indices = encoded.indices.to_numpy()
    owners = np.repeat(np.arange(len(counts)), counts)
    # splitting leaves empty words at the ends of a text
    empty = np.array([not w for w in distinct], dtype=bool)
    if empty.any() and len(indices):
        keep = ~empty[indices]
        indices, owners = indices[keep], owners[keep]
    return distinct, indices, np.searchsorted(owners, np.arange(len(counts) + 1))


def fingerprints(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def word_fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each word, A-Z lower-cased, of all texts in a row; and each text's offsets."""
    distinct, indices, offsets = encoded_words(texts)
    hashes = fingerprints(distinct)
    return hashes[indices] if len(indices) else np.zeros(0, np.uint64), offsets


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of ``width``-word shingles per text, sorted, with offsets.

    A text with fewer words has its whole sequence as its one shingle; one without words none.
    """
    words, offsets = word_fingerprints(texts)
    counts = np.diff(offsets)
    used = np.minimum(width, counts)
    n = np.where(counts > 0, counts - used + 1, 0)
    owner = np.repeat(np.arange(len(counts)), n)
    starts = np.concatenate(([0], np.cumsum(n)))
    first = np.arange(int(starts[-1])) - starts[owner] + offsets[owner] if len(owner) else np.zeros(0, np.int64)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    short = used[owner] if len(owner) else np.zeros(0, np.int64)
    out = np.zeros(len(owner), np.uint64)
    for k in range(width):
        out = np.where(k < short, mix64(out * np.uint64(31) + padded[first + k]), out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[fresh], owner[fresh]
    return out, np.searchsorted(owner, np.arange(len(counts) + 1))
