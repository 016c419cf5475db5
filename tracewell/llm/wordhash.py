"""Word and token hashes of Arrow strings, vectorised over the raw UTF-8 bytes.

A word is a run of ASCII letters and digits and of bytes above 127.  Its 64-bit
hash folds ASCII letter case, so equal words hash equally in any text and on any
machine.  Texts are read in slices that end between words: memory follows the
slice and the number of words, whatever the length of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_PLACE = mix(np.arange(1000, 1064, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_CLASS = np.where(_WORD, 1, np.where(_SPACE, 0, 2)).astype(np.uint8)


def texts_in_slices(arr: pa.Array, rows: int = 2048, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``rows`` rows and about ``size`` bytes, one row at least."""
    n = len(arr)
    if n == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(arr), 0)).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + size, "right"))
        to = min(max(to, at + 1), at + rows, n)
        yield at, to
        at = to


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings end to end, and where each begins (n + 1 offsets). A null is empty."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return body, off - off[0]


def _runs(kind: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the runs of equal non-zero ``kind``; a run also ends at a break."""
    if not len(kind):
        return (np.zeros(0, np.int64),) * 2 + (kind,)
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[breaks[(breaks > 0) & (breaks < len(kind))]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(kind))
    kinds = kind[starts]
    live = kinds > 0
    return starts[live], ends[live], kinds[live]


def tokens(body: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and hash of every word; with ``marks`` also of every run of other signs."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(body)
    while at < n:
        to = min(n, at + SLICE)
        while to < n and (held := _CLASS[body[to - 1]]) and held == _CLASS[body[to]]:
            step = body[to : to + SLICE]
            gap = np.flatnonzero(_CLASS[step] != held)
            to += int(gap[0]) if len(gap) else len(step)
        part = body[at:to]
        kind = _CLASS[part] if marks else _WORD[part].astype(np.uint8)
        lo, hi = np.searchsorted(offsets, (at, to))
        s, e, _ = _runs(kind, offsets[lo:hi] - at)
        if len(s):
            length = e - s
            owner = np.repeat(np.arange(len(s)), length)
            first = np.concatenate(([0], np.cumsum(length)[:-1]))
            place = np.arange(len(owner)) - first[owner]
            value = _BYTE[part[s[owner] + place]] * _PLACE[place & 63]
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(mix(np.add.reduceat(value, first) + length.astype(np.uint64)))
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each text's tokens begin among all tokens (n + 1 values)."""
    return np.searchsorted(starts, offsets)


def prefixes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: range) -> tuple[np.ndarray, np.ndarray]:
    """For tokens longer than each of ``sizes`` bytes: which token, and the hash of that many first bytes."""
    which, hashes = [], []
    total = np.zeros(len(starts), np.uint64)
    live = np.arange(len(starts))
    for k in range(1, sizes.stop):
        longer = (ends - starts)[live] > k
        live, total = live[longer], total[longer]
        total += _BYTE[body[starts[live] + k - 1]] * _PLACE[(k - 1) & 63]
        if k >= sizes.start:
            which.append(live)
            hashes.append(mix(total + U(k << 32)))
    return np.concatenate(which), np.concatenate(hashes)
