"""Words of many texts at once, and hashes of byte ranges, as numpy arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

#: Bytes of text that a task takes apart at once; a longer text is taken alone.
PIECE = 1_000_000

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words(NamedTuple):
    """Words of some texts: ``data`` has them joined by single spaces; word w is data[start[w]:end[w]].

    Text t has the words first[t] to first[t + 1].
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def split_words(texts: Iterable[str | None]) -> Words:
    """Lower-cases A-Z and splits at ASCII white space; null is empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buffer = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = _IS_SPACE[buffer]
    keep = np.empty(len(buffer), dtype=bool)
    keep[0] = True
    np.logical_not(space[1:] & space[:-1], out=keep[1:])
    data = buffer[keep]
    gap = space[keep]
    data[gap] = 0x20
    at = np.flatnonzero(gap)  # the first and the last byte are gaps, and there is one gap between words
    start, end = at[:-1] + 1, at[1:]
    # where each text begins among the kept bytes, and so the words before it
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    words_before = np.concatenate([[0], np.cumsum(~space[1:] & space[:-1])])
    first = words_before[np.minimum(begins, len(words_before) - 1)]
    return Words(data, start, end, first)


def pieces(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[int, list[str | None]]]:
    """(position of the first, texts) in runs of about ``most`` characters."""
    begun, size = 0, 0
    for n, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= most:
            yield begun, texts[begun : n + 1]
            begun, size = n + 1, 0
    if begun < len(texts):
        yield begun, texts[begun:]


# fixed values of XXH64
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _at(data: np.ndarray, kind: str) -> np.ndarray:
    """A view of ``data`` as numbers that begin at every byte."""
    size = np.dtype(kind).itemsize
    return np.ndarray(len(data) - size + 1, dtype=kind, buffer=data.data, strides=(1,))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each range data[start:end]."""
    data = np.concatenate([data, np.zeros(32, dtype=np.uint8)])
    u64, u32 = _at(data, "<u8"), _at(data, "<u4")
    length = (end - start).astype(np.int64)
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        out = np.full(len(start), s + _P5, dtype=np.uint64)
        longer = np.flatnonzero(length >= 32)
        if len(longer):
            begin, stripes = start[longer], length[longer] >> 5
            lanes = [np.full(len(longer), v, dtype=np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for k in range(int(stripes.max())):
                on = slice(None) if k == 0 else np.flatnonzero(stripes > k)
                for n, lane in enumerate(lanes):
                    lane[on] = _rotate(lane[on] + u64[begin[on] + (32 * k + 8 * n)] * _P2, 31) * _P1
            merged = _rotate(lanes[0], 1) + _rotate(lanes[1], 7) + _rotate(lanes[2], 12) + _rotate(lanes[3], 18)
            for lane in lanes:
                merged = (merged ^ (_rotate(lane * _P2, 31) * _P1)) * _P1 + _P4
            out[longer] = merged
        out += length.astype(np.uint64)
        at, rest = start + (length & ~31), length & 31
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            out[on] = _rotate(out[on] ^ (_rotate(u64[at[on] + 8 * k] * _P2, 31) * _P1), 27) * _P1 + _P4
        at, rest = at + (rest & ~7), rest & 7
        on = np.flatnonzero(rest >= 4)
        out[on] = _rotate(out[on] ^ (u32[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at, rest = at + (rest & 4), rest & 3
        for k in range(3):
            on = np.flatnonzero(rest > k)
            out[on] = _rotate(out[on] ^ (data[at[on] + k].astype(np.uint64) * _P5), 11) * _P1
        out ^= out >> np.uint64(33)
        out *= _P2
        out ^= out >> np.uint64(29)
        out *= _P3
        out ^= out >> np.uint64(32)
    return out
