"""64-bit hashes of the words of many texts at once, and of runs of words.

A word's hash is a polynomial of its bytes, taken from cumulative sums over a
whole block of text: no word is made a Python object. A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 18
_MASK = (1 << 64) - 1


def split_mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers, the same on every machine."""
    return np.array([split_mix((seed << 32) + i) | 1 for i in range(n)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RUN = constants(3, 64)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = words[:size] * _RUN[0]
    for j in range(1, n):
        out += words[j : j + size] * _RUN[j % len(_RUN)]
    return mix(out + np.uint64(n))


class WordHasher:
    def __init__(self, word_bytes: np.ndarray):
        """word_bytes: for each of the 256 bytes, whether it belongs to words."""
        self.inside = word_bytes.astype(bool)
        self.value = constants(1, 256)
        self.value[65:91] = self.value[97:123]
        base = int(constants(2, 1)[0])
        inverse = pow(base, -1, 1 << 64)
        self.power, self.inverse = (self.powers(b, BLOCK_BYTES * 2 + 2) for b in (base, inverse))

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = np.uint64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[: min(done, n - done)] * step
            done *= 2
        return out

    def block(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a block's words and where they begin."""
        if len(raw) >= len(self.power):  # one word that is longer than a block
            self.power, self.inverse = (self.powers(int(p[1]), len(raw) + 1) for p in (self.power, self.inverse))
        inside = self.inside[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts]), starts

    def pieces(self, text: bytes):
        """A long text in blocks that end between words."""
        at = 0
        while len(text) - at > BLOCK_BYTES:
            end = at + BLOCK_BYTES
            near = np.flatnonzero(~self.inside[np.frombuffer(text, np.uint8, BLOCK_BYTES, at)])
            if len(near):
                end = at + int(near[-1]) + 1
            else:
                while end < len(text) and self.inside[text[end]]:
                    end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def words(self, texts: list[bytes]) -> list[np.ndarray]:
        """The hashes of each text's words."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal held, size
            hashes, starts = self.block(np.frombuffer(b" ".join(p for _, p in held), np.uint8))
            ends = np.cumsum([len(p) + 1 for _, p in held])
            cuts = [0, *np.searchsorted(starts, ends).tolist()]
            for (row, _), a, b in zip(held, cuts, cuts[1:]):
                out[row].append(hashes[a:b])
            held, size = [], 0

        for row, text in enumerate(texts):
            for piece in self.pieces(text):
                held.append((row, piece))
                size += len(piece) + 1
                if size >= BLOCK_BYTES:
                    flush()
        if held:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out
