"""Words of UTF-8 texts in numpy: maximal runs of bytes other than space and 0x09-0x0D."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of a text, and windows of words, handled at once.
SEGMENT, _WINDOWS = 2 << 20, 1 << 20
#: Powers of an odd base and of its inverse, for hashes that roll along a text. Such hashes may only choose candidates: strings are easily made that share one.
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n + 1:
        size = max(n + 1, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("_powers", _BASE), ("_inverse", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (shift-multiply)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of all words: byte positions in data, and per row the index of its first word (n+1)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = ~_SPACE[data]
    flip = inside[1:] != inside[:-1]
    # a row's end also ends a word
    joint = offsets[1:-1]
    joint = joint[(joint > 0) & (joint < n)]
    both = np.zeros(n + 1, bool)
    both[joint] = inside[joint] & inside[joint + 1]
    starts = np.flatnonzero((flip | both) & inside[1:])
    ends = np.flatnonzero((flip | both) & inside[:-1])
    return starts, ends, np.searchsorted(starts, offsets)


#: By number of bytes, what of a lane counts.
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _lanes(data: np.ndarray, at: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Each lane of eight bytes from `at` on (zeros from `ends` on), mixed with its number within the range."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    return mix((eight[at] & _LANE[np.minimum(ends - at, 8)]) ^ mix(number.astype(np.uint64), 3), 1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal strings wherever they lie. Lanes of eight bytes are mixed with
    their number, which is not linear, before they are summed: so no pattern of bytes cancels out whatever the keys are."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    lanes = np.maximum((length + 7) >> 3, 1)
    first = np.cumsum(lanes) - lanes
    if len(lanes) == int(lanes.sum()):
        total = _lanes(data, starts, ends, np.zeros(len(starts), np.int64))
    else:
        number = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        total = np.add.reduceat(_lanes(data, np.repeat(starts, lanes) + 8 * number, np.repeat(ends, lanes), number), first)
    return mix(total + length.astype(np.uint64), 2)


def _long_hash(word: np.ndarray) -> int:
    """The hash of one very long word, part by part."""
    total = np.zeros(1, np.uint64)
    step = max(8, SEGMENT & ~7)
    for i in range(0, len(word), step):
        at = np.arange(i, min(i + step, len(word)), 8)
        total += _lanes(word[i : i + step], at - i, np.full(len(at), min(step, len(word) - i)), at >> 3).sum(dtype=np.uint64)
    return int(mix(total + np.uint64(len(word)), 2)[0])


_TRIMMED = np.zeros(256, bool)
_TRIMMED[list(b".,;:!?")] = True


def _word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, trim: bool) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data] if lower else data
    starts, ends, first = spans(low, offsets)
    if trim and len(ends):
        ends = ends - ((ends - starts > 1) & _TRIMMED[low[ends - 1]])
    return hashes(low, starts, ends), first


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, trim: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, with A-Z lower-cased or not, without one of .,;:!? behind them or with it, and each row's
    first word (n+1). A long row is taken in segments between words, so that memory stays near its words' hashes."""
    if len(data) <= SEGMENT:
        return _word_hashes(data, offsets, lower, trim)
    found, first, total = [], [0], 0
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while a < b:
            end = min(b, a + SEGMENT)
            if end < b:
                gaps = np.flatnonzero(_SPACE[data[a:end]])
                if len(gaps):
                    end = a + int(gaps[-1]) + 1
                else:  # within a word longer than a segment
                    while end < b and not _SPACE[data[end]]:
                        more = np.flatnonzero(_SPACE[data[end : min(b, end + SEGMENT)]])
                        end = end + int(more[0]) if len(more) else min(b, end + SEGMENT)
                    word = data[a:end]
                    last = len(word) - int(trim and bool(_TRIMMED[word[-1]]))
                    found.append(np.array([_long_hash(LOWER[word[:last]] if lower else word[:last])], np.uint64))
                    total, a = total + 1, end
                    continue
            part = _word_hashes(data[a:end], np.array([0, end - a]), lower, trim)[0]
            found.append(part)
            total, a = total + len(part), end
        first.append(total)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.array(first)


def shingles(word_hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word window, per row in text order, and the n+1 row bounds.

    A row of fewer than k words has its whole sequence as one shingle; a row without words has none.
    """
    total, counts = len(word_hashes), np.diff(first)
    if len(counts) == 1 and total > _WINDOWS:  # one long row, in parts
        out = np.empty(total - k + 1, np.uint64)
        for a in range(0, len(out), _WINDOWS):
            b = min(a + _WINDOWS, len(out))
            acc = np.zeros(b - a, np.uint64)
            for j in range(k):
                acc = mix(acc * np.uint64(0xD1342543DE82EF95) + word_hashes[a + j : b + j], j + 2)
            out[a:b] = mix(acc + np.uint64(k), 99)
        return out, np.array([0, len(out)])
    rows = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(rows)])
    if not total:
        return np.zeros(0, np.uint64), bounds
    # start word of every shingle
    row = np.repeat(np.arange(len(rows)), rows)
    start = np.arange(bounds[-1]) - bounds[row] + first[row]
    length = np.minimum(counts[row], k)
    acc = np.zeros(len(start), np.uint64)
    for j in range(k):
        use = j < length
        acc[use] = mix(acc[use] * np.uint64(0xD1342543DE82EF95) + word_hashes[start[use] + j], j + 2)
    return mix(acc + length.astype(np.uint64), 99), bounds
