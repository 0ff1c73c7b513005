"""Hashed character n-grams of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

_MULT = np.uint32(0x9E3779B1)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, with runs of white space and both ends as one space."""
    t = " " + " ".join(text.lower().split()) + " "
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def hashed(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """The hash (of `bits` bits) of every n-gram of the given sizes, repeats included."""
    c = code_points(text)
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), dtype=np.uint32)
        for n in range(1, max(sizes) + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] * np.uint32(31) + c[n - 1 :]) * _MULT
            h ^= h >> np.uint32(15)
            if n in sizes:
                out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


class Distinct:
    """Distinct hashes of one text after another, without sorting."""

    def __init__(self, bits: int):
        self.mask = np.zeros(1 << bits, dtype=bool)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < 4096:
            return np.unique(ids)
        self.mask[ids] = True
        found = np.flatnonzero(self.mask)
        self.mask[found] = False
        return found.astype(np.int32)
