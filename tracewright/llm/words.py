"""Word and character-run hashes of whole groups of texts, computed with numpy inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(U, copy=True)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_POWERS = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int, which: str) -> np.ndarray:
    """BASE (or its inverse) to the powers 0..n-1, modulo 2**64."""
    have = _POWERS[which]
    if len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, BASE if which == "up" else pow(BASE, -1, 1 << 64), U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if size <= 1 << 22:
            _POWERS[which] = have
    return have[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * powers(len(codes), "up"), dtype=U, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each span, the same wherever the span lies (Karp-Rabin by prefix sums)."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), "down")[starts]
    return mix(raw + (ends - starts).astype(U))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its lower-case code point where that is a single one."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x32000):
        c = chr(cp)
        if c.isalpha():
            letter[cp] = True
            low = c.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    # Combining marks belong to the word they stand in.
    letter[0x300:0x370] = True
    return letter, lower


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_words(group: list[str], digits: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letter runs of a group of texts: code points and their prefix sums, starts, ends, number of the text."""
    letter, lower = characters()
    low = lower[code_points("\n".join(group))]
    mask = letter[low]
    if digits:
        mask = mask | ((low >= 48) & (low <= 57))
    starts, ends = runs(mask)
    bounds = np.cumsum([len(t) + 1 for t in group])
    return low, prefix_sums(low.astype(U) + U(1)), starts, ends, np.searchsorted(bounds, starts, "right")


def places(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in the sorted keys, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)
