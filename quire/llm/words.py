"""Words, shingles and character n-grams of Arrow text columns as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes worked on at once. Arrays of eight bytes for each of them come and go.
PART = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two rounds of xor, shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F % (1 << 64)))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PART + 4096, n)
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.concatenate([np.ones(1, _U), np.multiply.accumulate(np.full(size, b, _U))]) for b in (_BASE, _INVERSE))
    return _powers[size]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: none) and the n + 1 offsets between its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]] if len(ends) else whole[:0], ends - ends[0]


def _parts(flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PART that part no word: they end between texts, or in a long text at white space."""
    at, n = 0, len(flat)
    while at < n:
        to = min(n, at + PART)
        if to < n:
            edge = ends[np.searchsorted(ends, to, "right") - 1]
            if edge > at:
                to = int(edge)
            else:
                while to < n and flat[to] != 32 and not 9 <= flat[to] <= 13:
                    to += 1
        yield at, to
        at = to


def _lower(flat: np.ndarray) -> np.ndarray:
    return np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)


def word_hashes(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased; runs of bytes other than space and 9 to 13), and the first word of each text."""
    hashes, places = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    opens = np.zeros(len(flat) + 1, bool)
    opens[ends] = True
    for lo, hi in _parts(flat, ends):
        b = _lower(flat[lo:hi])
        power, inverse = _power_tables(len(b))
        word = (b != 32) & ((b < 9) | (b > 13))
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        edge = opens[lo:hi]
        starts = np.flatnonzero(word & (~before | edge))
        stop = np.flatnonzero(before & (~word | edge))
        if len(stop) < len(starts):
            stop = np.append(stop, len(b))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[b] * power[: len(b)], dtype=_U)])
            hashes.append(mix((total[stop] - total[starts]) * inverse[starts] + (stop - starts).astype(_U)))
        places.append(starts + lo)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), ends)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct k-word shingle hashes; with 1 to k - 1 words the whole sequence, without words none."""
    flat, ends = text_bytes(texts)
    words, first = word_hashes(flat, ends)
    keys = [_U(pow(0xE7037ED1A0B428DB, i + 1, 1 << 64)) for i in range(k)]
    with np.errstate(over="ignore"):
        n = len(words) - k + 1
        grams = mix(sum((words[i : i + n] * keys[i] for i in range(1, k)), words[:n] * keys[0])) if n > 0 else words[:0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix(np.array([(sum(int(w) * int(keys[i]) for i, w in enumerate(words[a:b])) + int(b - a) * 0x589965CC75374CC3) & (1 << 64) - 1], _U))
        else:
            yield words[:0]
