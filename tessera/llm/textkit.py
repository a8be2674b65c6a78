"""Vectorised word and shingle hashing over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer text is cut at white space, so memory is bounded by this and the word hashes.
BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out


_tables: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _tables:
        _tables.extend((_powers(_BASE, BLOCK + 1), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)))
    return _tables


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each text starts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _hash_block(raw: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of raw, and each word's start; no word crosses a cut."""
    power, inverse = _power_tables()
    space = _SPACE[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[1:] | space[:-1]
    edge[cuts] = True
    solid = ~space
    starts = np.flatnonzero(solid & edge[:-1])
    ends = np.flatnonzero(solid & edge[1:]) + 1
    values = (_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * power[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), starts


def word_hashes(column: pa.Array, lower: bool) -> Iterator[np.ndarray]:
    """For each text, the 64-bit hashes of its words `[^\\x20\\x09-\\x0D]+`, in order."""
    raw, at = text_buffer(column)
    n, k = len(at) - 1, 0
    with np.errstate(over="ignore"):
        while k < n:
            if at[k + 1] - at[k] > BLOCK:
                yield _long(raw[at[k] : at[k + 1]], lower)
                k += 1
                continue
            to = max(k + 1, int(np.searchsorted(at, at[k] + BLOCK, "right")) - 1)
            block = raw[at[k] : at[to]]
            if not len(block):
                yield from (np.zeros(0, np.uint64) for _ in range(k, to))
            else:
                h, starts = _hash_block(block, at[k : to + 1] - at[k], lower)
                of = np.searchsorted(starts, at[k : to + 1] - at[k])
                for i in range(to - k):
                    yield h[of[i] : of[i + 1]]
            k = to


def _long(raw: np.ndarray, lower: bool) -> np.ndarray:
    """A text of more than BLOCK bytes, cut at white space; a single word longer than that is hashed from the hashes of its blocks."""
    out, k, open_word = [], 0, []
    while k < len(raw):
        to = min(len(raw), k + BLOCK)
        if to < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[k:to]])
            to = k + int(gaps[-1]) + 1 if len(gaps) else to
        h, starts = _hash_block(raw[k:to], np.zeros(1, np.int64), lower)
        ends_open = to < len(raw) and not _SPACE[raw[to - 1]]
        if open_word and len(h) and starts[0] == 0:
            open_word.append(h[0])
            h = h[1:]
        if open_word and (len(h) or not ends_open):
            out.append(mix(np.bitwise_xor.reduce(mix(np.array(open_word, np.uint64) + np.arange(len(open_word), dtype=np.uint64)), keepdims=True)))
            open_word = []
        if ends_open and len(h) and not open_word:
            open_word = [h[-1]]
            h = h[:-1]
        out.append(h)
        k = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of width words; a shorter text is one window; no words, none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < width:
            return mix((words * _MULTIPLIERS[:n]).sum(keepdims=True) + np.uint64(n))
        h = words[: n - width + 1] * _MULTIPLIERS[0]
        for j in range(1, width):
            h = h + words[j : n - width + 1 + j] * _MULTIPLIERS[j]
        return mix(h)
