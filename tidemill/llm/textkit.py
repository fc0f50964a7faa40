"""Array-at-a-time word handling over Arrow string columns.

Texts are treated as UTF-8 bytes; only A-Z is lower-cased.  A word is a maximal
run of bytes that a 256-entry table marks as word bytes, which makes the two
word classes used here (`WORDS_SPACE`, `WORDS_ALNUM`) exact for any Unicode
text, since every byte of a non-ASCII character is above 0x7F.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: words [^\x20\x09-\x0D]+
WORDS_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
WORDS_ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)
#: bytes of text that one step works on; a longer document is a step of its own
STEP_BYTES = 1 << 20

_MASK = (1 << 64) - 1
#: longer ranges are hashed one by one
_LONG = 1024
#: the low bytes of a lane that belong to a range with so many bytes left
PART = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, eights: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each range of bytes, lane by lane; other seeds give independent hashes."""
    eights = lanes(data) if eights is None else eights
    length = end - start
    out = mix(length.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & _MASK))
    for k in np.flatnonzero(length > _LONG):
        digest = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
        out[k] = int.from_bytes(digest.digest(), "little")
    live = np.flatnonzero((length > 0) & (length <= _LONG))
    begin, left, own = start[live], length[live], out[live]
    while len(live):
        own = mix(own ^ (eights[begin] & PART[np.minimum(left, 8)]))
        more = left > 8
        out[live] = own
        live, begin, left, own = live[more], begin[more] + 8, left[more] - 8, own[more]
    return out


def same_bytes(eights: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges of bytes that begin at a and at b, of equal length, are the same; eights are `lanes`."""
    out = np.ones(len(length), bool)
    for k in np.flatnonzero(length > _LONG):
        n = length[k] - 7
        out[k] = np.array_equal(eights[a[k] : a[k] + n], eights[b[k] : b[k] + n])
    live = np.flatnonzero((length > 0) & (length <= _LONG) & (a != b))
    a, b, left = a[live], b[live], length[live]
    while len(live):
        same = ((eights[a] ^ eights[b]) & PART[np.minimum(left, 8)]) == 0
        out[live] = same
        more = same & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return out


class Words:
    """The words of some documents.

    lower: the bytes, lower-cased; start, end: byte places of each word;
    bounds: documents + 1 places in the list of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data = data
        raw = data.tobytes()
        self.lower = np.frombuffer(raw.translate(LOWER.tobytes()), np.uint8)
        self.offsets = offsets
        inside = np.frombuffer(raw.translate(is_word.tobytes()), bool)
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(data):
            before[1:], before[0] = inside[:-1], False
            after[:-1], after[-1] = inside[1:], False
            cuts = offsets[(offsets > 0) & (offsets < len(data))]
            before[cuts] = False
            after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    @cached_property
    def eights(self) -> np.ndarray:
        return lanes(self.lower)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's lower-cased bytes."""
        return range_hashes(self.lower, self.start, self.end, seed, self.eights)

    def word(self, i: int) -> bytes:
        return self.lower[self.start[i] : self.end[i]].tobytes()


def runs(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, texts + 1 offsets in them) for runs of rows of about `step` bytes; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, side="right")) - 1)
        last = min(last, n)
        part = offsets[row : last + 1]
        yield row, data[part[0] : part[-1]], part - part[0]
        row = last


def batches(texts: pa.Array, is_word: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, Words]]:
    """(first row, words) for runs of rows."""
    for row, data, offsets in runs(texts, step):
        yield row, Words(data, offsets, is_word)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of one document; a shorter document is one run, an empty one none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += words[k : k + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1) + (k << 32)) & _MASK | 1)
    return mix(out)


def crc_mod(column, n: int):
    """crc32(column as text) mod n, as a Spark column."""
    from pyspark.sql import functions as F

    return F.crc32(column.cast("string").cast("binary")) % n
