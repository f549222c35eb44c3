"""Word shingles as 64-bit hashes, in numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Random values of the bytes, fixed by a seed; A-Z have those of a-z.
LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LETTER[65:91] = LETTER[97:123]
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
ODD = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at a time, where texts aren't longer.
CHUNK = 1 << 18


def scatter(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no pattern."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of `width` words, lower-cased A-Z; a shorter text is one shingle, one without words none."""

    def __init__(self, width: int = 5):
        self.width = width
        self.up = self.down = np.ones(0, np.uint64)

    def __getstate__(self) -> dict:
        return {"width": self.width, "up": self.up[:0], "down": self.down[:0]}

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK)
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                p = np.full(n, np.uint64(base))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words: a polynomial of the bytes, from its prefix sums."""
        b = np.frombuffer(data, np.uint8)
        self.powers(len(b) + 1)
        blank = BLANK[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(LETTER[b] * self.up[: len(b)], out=sums[1:])
        return start, scatter((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Sorted hashes of each text. Two different shingles share one with a chance of about 2**-64."""
        chunk: list[bytes] = []
        size = 0
        for t in texts:
            data = t.encode("utf-8", "surrogatepass")
            if chunk and size + len(data) > CHUNK:
                yield from self.chunk(chunk)
                chunk, size = [], 0
            chunk.append(data)
            size += len(data) + 1
        if chunk:
            yield from self.chunk(chunk)

    def chunk(self, parts: list[bytes]) -> Iterator[np.ndarray]:
        start, h = self.words(b"\n".join(parts))
        bounds = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        full = np.full(max(0, len(h) - self.width + 1), self.width, np.uint64)
        for k in range(self.width):
            full = self.add(full, h[k : k + len(full)])
        full = scatter(full)
        for a, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - a >= self.width:
                yield np.unique(full[a : e - self.width + 1])
            elif e > a:
                x = np.full(1, e - a, np.uint64)
                for k in range(a, e):
                    x = self.add(x, h[k : k + 1])
                yield scatter(x)
            else:
                yield np.empty(0, np.uint64)

    @staticmethod
    def add(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        x = (x + h) * ODD
        return x ^ (x >> np.uint64(29))

    def __call__(self, text: str) -> np.ndarray:
        return next(self.many([text]))
