"""Words and their fingerprints as flat Arrow / numpy arrays, for use inside tasks.

All functions take one bounded chunk of documents. Texts are read whole; null counts as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 4 << 20

#: Byte tables. Every separator is one ASCII byte, so bytes above 0x7F are always part of a word.
SPACES = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)
SPACES_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))

RADIX = np.uint64(0x9E3779B97F4A7C15)
RADIX_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunks(batches, column: str = "text", max_bytes: int = CHUNK_BYTES):
    """Cut Arrow batches to chunks whose texts take at most max_bytes, or one document."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
    give_back()  # the worker process may serve other stages


def give_back() -> None:
    """Returns memory that the process no longer uses to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def flat_words(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """All words of the chunk in order, and where each document's words begin (one more entry than documents)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(bytes(memoryview(data)).translate(table)) if data is not None else pa.py_buffer(b"")
    clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, data], offset=texts.offset)
    lists = pc.split_pattern(clean, " ")
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy()
    kept = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    return flat.filter(kept), before[bounds - bounds[0]].astype(np.int64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return distinct[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of the ``width`` words from each position (polynomial over the word fingerprints); the caller masks document ends."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    powers = np.full(n + 1, RADIX, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    inverse = np.full(n, RADIX_INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n], dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * inverse[: n - width + 1])


def starts_inside(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (over the chunk) at which ``width`` words of one document begin, and the document of each."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(docs)) - np.repeat(np.cumsum(counts) - counts, counts)
    return bounds[:-1][docs] + within, docs


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers starts[i] .. starts[i] + counts[i] - 1 for every i, one after another."""
    total = int(counts.sum())
    out = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return out + np.repeat(starts, counts)


def joined(words: pa.Array, bounds: np.ndarray) -> list[bytes]:
    """The words of each document joined by one space, as UTF-8."""
    lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), words.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()
