"""Hashes of word shingles, for many texts at once.

Words are runs without ASCII white space, A-Z in lower case. A word's hash is a
polynomial in random values of its bytes, modulo 2 ** 64, taken as a difference of
prefix sums over all texts, and mixed; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at a time.
PIECE = 1 << 20

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # 5 modulo 8: powers differ by few factors of two
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUE = np.random.default_rng(3).integers(1, 1 << 64, 256, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, 1 << 64))
        more = min(size, n - size)
        out[size : size + more] = out[:more] * step
        size *= 2
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLY
    return h ^ (h >> np.uint64(29))


def _pieces(data: bytes):
    """Parts of ``data`` of about PIECE bytes, cut after white space."""
    start = 0
    while len(data) - start > PIECE:
        end = start + PIECE
        space = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, PIECE, start)])
        if len(space):
            end = start + int(space[-1]) + 1
        else:  # a word that is longer than a piece stays whole
            rest = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, -1, end)])
            end = end + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[start:end]
        start = end
    yield data[start:]


class Shingles:
    def __init__(self, words: int):
        self.words = words
        self.up = self.down = np.zeros(0, np.uint64)

    def _hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of ``data``, and where they start."""
        raw = np.frombuffer(data, np.uint8)
        if len(self.up) < len(raw):
            n = max(len(raw), min(PIECE, 2 * len(raw)))
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        word = ~_SPACE[raw]
        edge = np.diff(np.r_[False, word, False].astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * self.up[: len(raw)], out=sums[1:])
        return mix((sums[last] - sums[first]) * self.down[first]), first

    def words_of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in a row, and how many each text has."""
        data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        hashes, sizes, held, size = [], np.zeros(len(texts), np.int64), [], 0

        def flush():
            if held:
                h, first = self._hashes(b" ".join(data[i] for i in held))
                ends = np.cumsum([len(data[i]) + 1 for i in held])
                sizes[held] = np.diff(np.r_[0, np.searchsorted(first, ends)])
                hashes.append(h)

        for i, d in enumerate(data):
            if len(d) > PIECE:
                flush()
                held, size = [], 0
                parts = [self._hashes(p)[0] for p in _pieces(d)]
                sizes[i] = sum(map(len, parts))
                hashes += parts
                continue
            if size + len(d) > PIECE:
                flush()
                held, size = [], 0
            held.append(i)
            size += len(d) + 1
        flush()
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), sizes

    def sequences(self, texts: list, short: bool = False) -> list[np.ndarray]:
        """Each text's shingle hashes in order (int64); with ``short``, a text of fewer words is one shingle."""
        h, sizes = self.words_of(texts)
        n = self.words
        s = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for i in range(n):
            s = mix(s) + h[i : len(h) - n + 1 + i]
        s = mix(s).view(np.int64)
        out, start = [], 0
        for size in sizes.tolist():
            if size >= n:
                out.append(s[start : start + size - n + 1])
            elif size and short:
                one = np.full(1, size, np.uint64)
                for i in range(size):
                    one = mix(one) + h[start + i : start + i + 1]
                out.append(mix(one).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
            start += size
        return out

    def sets(self, texts: list) -> list[np.ndarray]:
        """Each text's sorted distinct shingle hashes; a text of fewer words is one shingle."""
        return [np.unique(s) for s in self.sequences(texts, short=True)]
