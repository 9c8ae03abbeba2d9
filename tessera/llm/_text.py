"""Vectorised byte-level text primitives that the corpus operators share.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. A word's hash sums a random code for each pair of
place and byte, so no structure of a word makes two collide; hashing a text is a handful of numpy passes whatever
its number of words. Spans at any place (k-grams, windows) have polynomials: :func:`prefix_hash` modulo 2**64
where a collision only costs time, and :func:`prefix_marks` modulo two primes where equality is decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x5851F42D4C957F2D
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# The multipliers and shifts of the published splitmix64 finaliser.
def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(fold_case: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


CODES = _codes(False)
FOLDED = _codes(True)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _kept(n: int) -> int:
    """Entries of a table that is kept for n or more: up to a chunk the next power of two and one, so that it seldom grows."""
    return (1 << max(n - 2, (1 << 17) - 1).bit_length()) + 1 if n <= CHUNK_BYTES + 1 else n


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept between calls."""
    if len(_powers[0]) < n:
        size = _kept(n)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray, fold_case: bool) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` reads the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((FOLDED if fold_case else CODES)[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix))[1][start] + (stop - start).astype(np.uint64))


#: Primes below 2**31 and bases of the two fingerprints.
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1803442709), np.uint64(928513371))
_mark_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _marks_of(n: int) -> list[np.ndarray]:
    """The first n powers of both bases, and of their inverses, modulo the primes; kept between calls."""
    if len(_mark_powers[0]) < n or len(_mark_powers) < 4:
        size = _kept(n)
        bases = [*_BASES, *(np.uint64(pow(int(b), -1, int(p))) for b, p in zip(_BASES, _PRIMES, strict=True))]
        out = []
        for b, p in zip(bases, _PRIMES * 2, strict=True):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                step = np.uint64(pow(int(b), len(table), int(p)))
                table = np.concatenate((table, table[: size - len(table)] * step % p))
            out.append(table)
        _mark_powers[:] = out
    return [x[:n] for x in _mark_powers]


def prefix_marks(data: np.ndarray) -> list[np.ndarray]:
    """Prefix sums from which :func:`span_marks` reads the fingerprint of any span."""
    out = []
    for power, prime in zip(_marks_of(len(data))[:2], _PRIMES, strict=True):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power % prime, out=sums[1:])
        out.append(sums)
    return out


def span_marks(marks: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """62 bits of two polynomials modulo primes; unlike those modulo 2**64 they have no texts that always collide."""
    inverse = _marks_of(len(marks[0]))[2:]
    a, b = ((m[stop] - m[start]) % p * i[start] % p for m, p, i in zip(marks, _PRIMES, inverse, strict=True))
    return mix((a << np.uint64(31)) ^ b) + (stop - start).astype(np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and the n+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes at most: first row, bytes, offsets."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text (and one beyond) its first word."""
    inner = ~IS_SPACE[data]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inner[:-1]
    before[inside] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inner[1:]
    after[inside - 1] = False
    starts = np.flatnonzero(inner & ~before)
    stops = np.flatnonzero(inner & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def _placed(fold_case: bool) -> np.ndarray:
    codes = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _GOLDEN).reshape(64, 256)
    if fold_case:
        codes[:, 65:91] = codes[:, 97:123]
    return codes.ravel()


_PLACED = _placed(True)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded word hashes of a chunk, and each text's first word."""
    starts, stops, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    sizes = stops - starts
    body = data[~IS_SPACE[data]]  # words end to end
    edges = np.cumsum(sizes) - sizes
    place = np.arange(len(body), dtype=np.int32)
    place -= np.repeat(edges.astype(np.int32), sizes)
    at = place & 63
    at <<= 8
    at += body
    codes = np.take(_PLACED, at)
    if sizes.max() > 64:
        far = np.flatnonzero(place > 63)
        codes[far] *= mix((place[far] >> 6).astype(np.uint64) * _GOLDEN) | np.uint64(1)
    return mix(np.add.reduceat(codes, edges) + mix(sizes.astype(np.uint64))), first


_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the width-word shingles of one text; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        total += words[k : k + n] * _PLACES[k]
    return mix(total)


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes."""
    for _, data, offsets in chunks(column, 1 << 18):
        words, first = word_hashes(data, offsets)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield distinct_sorted(shingle_hashes(words[a:b], width))
