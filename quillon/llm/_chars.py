"""Texts of an Arrow batch as arrays of code points, for work that is vectorised over characters."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Code points that are worked on at once (a longer text is a block of its own).
BLOCK = 1_000_000
SPACE = 32


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, its lower case where that is one code point,
    and whether it is a letter or digit."""
    letter, lower, word = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        char = chr(code)
        word[code] = char.isalnum()
        if char.isalpha():
            letter[code] = True
            low = char.lower()
            if len(low) == 1:
                lower[code] = ord(low)
    return letter, lower, word


def blocks(texts: pa.Array, gap: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, code points, starts) of runs of texts, each text followed by ``gap`` spaces; nulls are empty."""
    values = [t or "" for t in texts.to_pylist()]
    at = 0
    while at < len(values):
        end, held = at, 0
        while end < len(values) and (end == at or held + len(values[end]) <= BLOCK):
            held += len(values[end]) + gap
            end += 1
        part = values[at:end]
        codes = np.frombuffer((" " * gap).join([*part, ""]).encode("utf-32-le"), "<u4")
        lengths = np.array([len(t) + gap for t in part], np.int64)
        yield slice(at, end), codes, np.cumsum(lengths) - lengths
        at = end


_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def folded(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each code point's lower case."""
    mixed = tables()[1][codes].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def run_hashes(hashed: np.ndarray, inside: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of characters."""
    if not len(lo):
        return np.zeros(0, np.uint64)
    opens = np.concatenate([[0], lo])
    place = np.arange(len(hashed)) - np.repeat(opens, np.diff(np.append(opens, len(hashed))))
    keys = np.add.reduceat(np.where(inside, hashed * _POWERS[place % 64], np.uint64(0)), lo)
    keys ^= (hi - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return keys ^ (keys >> np.uint64(31))


def words(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits of a block: start, end, which text, hash of the lower-cased word."""
    inside = tables()[2][codes]
    lo, hi = runs(inside)
    return lo, hi, np.searchsorted(starts, lo, side="right") - 1, run_hashes(folded(codes), inside, lo, hi)
