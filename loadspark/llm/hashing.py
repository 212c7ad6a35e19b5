"""64-bit hashes of byte strings in numpy."""

from __future__ import annotations

import numpy as np

SEED = 77


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed random 64-bit values."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = seeded(256, SEED)
POWER = 0x9E3779B97F4A7C15


#: Two primes below 2^31, and a base for each: polynomials over prime fields have no structured strings that cancel out.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525021)


def powers(base: int, n: int, prime: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo a prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


class Substrings:
    """Hashes of substrings of one byte array, each in constant time from running sums: 62 bits, 31 from each prime."""

    def __init__(self, longest: int):
        self.tables = [
            (np.uint64(p), BYTE_VALUES % np.uint64(p), powers(b, longest + 1, p), powers(pow(b, -1, p), longest + 1, p))
            for p, b in zip(PRIMES, BASES, strict=True)
        ]

    def read(self, data: np.ndarray) -> Substrings:
        self.sums = []
        for p, values, power, _ in self.tables:
            sums = np.zeros(len(data) + 1, np.uint64)
            # Below 2^31 each, so that 2^33 of them fit.
            np.cumsum(values[data] * power[: len(data)] % p, dtype=np.uint64, out=sums[1:])
            self.sums.append(sums)
        return self

    def _joined(self, differences: list[np.ndarray], start: np.ndarray | slice) -> np.ndarray:
        one, two = (d % p * inverse[start] % p for d, (p, _, _, inverse) in zip(differences, self.tables, strict=True))
        return mix(one << np.uint64(31) | two)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair."""
        return self._joined([s[end] - s[start] for s in self.sums], start)

    def all(self, length: int) -> np.ndarray:
        """Hash of every substring of one length, by start."""
        n = len(self.sums[0]) - length
        return self._joined([s[length:] - s[:n] for s in self.sums], slice(0, n))
