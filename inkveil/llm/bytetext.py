"""Vectorised word work on the raw UTF-8 bytes of Arrow string columns.

Words are runs of bytes of one class. Their 64-bit digests take eight bytes of all words in a step, so cost
per word is a few vector operations. Texts are worked on in runs of about SEGMENT bytes; a longer one stands alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 19

#: ASCII lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Words over so many bytes are digested by a cryptographic hash, one by one.
LONG_WORD = 256

_KEY = 0x6A09E667F3BCC908
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Masks that keep the first k bytes of eight.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each starts (one more entry than texts); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of up to limit bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased data: the words' starts and ends, and each text's first word (one more entry than texts)."""
    inside = is_word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] |= inside[cuts]
    end[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = _KEY) -> np.ndarray:
    """A 64-bit digest of each word, which depends on its length and bytes alone, whatever words are beside it.

    Eight bytes at a time go through a keyed non-linear mixing, which is a bijection of them: words of up to eight bytes and of
    one length never share a digest. Longer ones may, by chance or (to whoever knows the key) by design, so where equality of
    digests decides anything, equal() or faithful() must confirm it.
    """
    eights, length = _eights(data), ends - starts
    seed = mix(length.astype(np.uint64) + np.uint64(key))
    out = mix((eights[starts] & _FIRST[np.minimum(length, 8)]) ^ seed)
    done, live = 8, np.flatnonzero((length > 8) & (length <= LONG_WORD))
    while len(live):
        left = length[live] - done
        out[live] = mix((out[live] * _MULTIPLIER) ^ (eights[starts[live] + done] & _FIRST[np.minimum(left, 8)]) ^ seed[live])
        done += 8
        live = live[left > 8]
    secret = key.to_bytes(8, "little")
    for k in np.flatnonzero(length > LONG_WORD):
        out[k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=secret).digest(), np.uint64)[0]
    return out


def equal(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether each word of a has the bytes of the word of b at the same place in the list."""
    length = a_ends - a_starts
    out = length == b_ends - b_starts
    x, y = _eights(a), _eights(b)
    done, live = 0, np.flatnonzero(out & (length <= LONG_WORD))
    while len(live):
        left = length[live] - done
        same = ((x[a_starts[live] + done] ^ y[b_starts[live] + done]) & _FIRST[np.minimum(left, 8)]) == 0
        out[live[~same]] = False
        done += 8
        live = live[same & (left > 8)]
    for k in np.flatnonzero(out & (length > LONG_WORD)):
        out[k] = a[a_starts[k] : a_ends[k]].tobytes() == b[b_starts[k] : b_ends[k]].tobytes()
    return out


def faithful(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: np.ndarray) -> bool:
    """Whether words of equal digest have equal bytes."""
    order = np.argsort(digest, kind="stable")
    at = np.flatnonzero(digest[order[1:]] == digest[order[:-1]])
    i, j = order[at], order[at + 1]
    return bool(equal(data, starts[i], ends[i], data, starts[j], ends[j]).all())


_rng = np.random.Generator(np.random.PCG64(20240501))
_FACTORS = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]


def shingles(word: np.ndarray, size: int) -> np.ndarray:
    """Digests of the runs of size words; of the whole sequence where there are fewer words."""
    n = len(word)
    if n == 0:
        return word
    k = min(n, size)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total = mix(total * _FACTORS[i % 64] ^ word[i : n - k + 1 + i])
    return mix(total + np.uint64(k))
