"""Plain forms of texts and rolling hashes of their stretches."""

from __future__ import annotations

import numpy as np

#: An odd factor and its inverse modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_plain: list = []
_powers: dict = {}


def plain_table() -> np.ndarray:
    """Code point to its lower case (the first of several), other than letters and digits to a space."""
    if not _plain:
        _plain.append(np.fromiter((ord(chr(c).lower()[0]) if chr(c).isalnum() else 32 for c in range(0x110000)), np.uint32, 0x110000))
    return _plain[0]


def plain_points(text: str) -> np.ndarray:
    """Code points of a text in lower case, with one space for each run of anything but letters and digits, none at the end."""
    points = plain_table()[np.frombuffer(f"{text} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = points != 32
    keep[1:] |= keep[:-1]
    points = points[keep]
    return points[:-1] if len(points) and points[-1] == 32 else points


def spelt(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(base: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of ``base`` modulo 2 ** 64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        step = np.full(max(n, 4096), base, np.uint64)
        step[0] = 1
        _powers[int(base)] = known = np.multiply.accumulate(step)
    return known[:n]


def prefix_sums(points: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows: (sums[end] - sums[start]) * UNBASE ** start."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * power(BASE, len(points)), dtype=np.uint64)])


def window_keys(sums: np.ndarray, length: int, windows: int) -> np.ndarray:
    """Hashes of the first ``windows`` stretches of ``length`` points; the high bits depend on every point."""
    return (sums[length : length + windows] - sums[:windows]) * power(UNBASE, windows)


def keys_at(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Hashes of the stretches of ``lengths`` points from each of ``starts`` on."""
    return (sums[starts + lengths] - sums[starts]) * power(UNBASE, len(sums))[starts]
