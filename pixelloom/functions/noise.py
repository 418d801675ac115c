"""Seeded noise in numpy: a sequence of 64-bit states, hashes of places, value noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
GOLDEN = _U(0x9E3779B97F4A7C15)
#: What is combined with a user's seed, for each use.
SEEDS = {
    "film_grain": 0xA5A5A5A500010001, "gaussian": 0xA5A5A5A500020002, "uniform": 0xA5A5A5A500030003, "salt_pepper": 0xA5A5A5A500040004,
    "poisson": 0xA5A5A5A500050005, "glitch": 0xA5A5A5A500060006, "kmeans": 0xA5A5A5A500080008,
}


def finish(z: np.ndarray) -> np.ndarray:
    """Output function of SplitMix64."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


class Sequence:
    """The stream of SplitMix64 from a seed. The state is a counter, so any stretch is made at once."""

    def __init__(self, seed: int, use: str):
        self.seed, self.at = _U((int(seed) ^ SEEDS[use]) & (2**64 - 1)), 0

    def unit(self, n: int) -> np.ndarray:
        """The next n values in [0, 1), of 24 bits."""
        with np.errstate(over="ignore"):
            state = self.seed + GOLDEN * np.arange(self.at + 1, self.at + n + 1, dtype=np.uint64)
            self.at += n
            return (finish(state) >> _U(40)).astype(np.float64) / (1 << 24)

    def gaussian(self, n: int) -> np.ndarray:
        """The next n standard normal values (Box and Muller, the cosine only)."""
        return normal(self.unit(2 * n))

    def units(self, block: int) -> Iterator[float]:
        """The values one by one without end, made in blocks: for draws whose number hangs on what was drawn."""
        while True:
            yield from self.unit(block).tolist()


def normal(u: np.ndarray) -> np.ndarray:
    """Standard normal values of pairs of values in [0, 1)."""
    return np.sqrt(-2 * np.log(np.maximum(u[::2], 1e-10))) * np.cos(2 * np.pi * u[1::2])


def place_hash(x: np.ndarray, y: np.ndarray | int, seed: int) -> np.ndarray:
    """Hash of places."""
    with np.errstate(over="ignore"):
        return finish(((np.asarray(x, np.uint64) | (np.asarray(y, np.uint64) << _U(32))) ^ _U(seed & (2**64 - 1))) + GOLDEN)


def place_noise(x: np.ndarray, y: np.ndarray | int, seed: int) -> np.ndarray:
    """Noise in [-1, 1) at integer places."""
    return (place_hash(x, y, seed) >> _U(40)).astype(np.float64) / (1 << 23) - 1


def _fraction(v: np.ndarray) -> np.ndarray:
    return v - np.trunc(v)


def lattice(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pseudo-random value of lattice points."""
    k, q = 0.3183099, 0.3678794
    u, v = x * k + q, y * q + k
    return _fraction(16 * k * _fraction(u * v * (u + v)))


def value_noise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothly interpolated lattice values."""
    i, j = np.floor(x), np.floor(y)
    u, v = x - i, y - j
    u, v = u * u * (3 - 2 * u), v * v * (3 - 2 * v)
    top = lattice(i, j) * (1 - u) + lattice(i + 1, j) * u
    low = lattice(i, j + 1) * (1 - u) + lattice(i + 1, j + 1) * u
    return top * (1 - v) + low * v


def cellular(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance to the nearest feature point, one for each lattice cell; 1 at most."""
    i, j = np.floor(x), np.floor(y)
    best = np.ones_like(x)
    for dj in (-1, 0, 1):
        for di in (-1, 0, 1):
            a, b = i + di, j + dj
            best = np.minimum(best, np.hypot(a + lattice(a, b) - x, b + lattice(a + 127.1, b + 311.7) - y))
    return best


def octaves(noise, x: np.ndarray, y: np.ndarray, n: int, persistence: float, lacunarity: float = 2.0) -> np.ndarray:
    """Weighted mean of noise at rising frequencies."""
    weights = persistence ** np.arange(n)
    return sum(w * noise(x * lacunarity**k, y * lacunarity**k) for k, w in enumerate(weights)) / weights.sum()
