"""Vectorised words and shingles over many texts at once.

Texts are joined into one byte buffer; words are found by a table of separator bytes and hashed through prefix sums of
a polynomial modulo 2**64, so no Python object is made per word.
"""

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Stafford's finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed)) | U64(1)


_LETTER = constants(256, 11)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the largest buffer so far."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            _POWERS[0] = tuple(np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (_BASE, _BASE_INVERSE))
    return _POWERS[0]


#: Tables over bytes: true where the byte belongs to a word.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True


class Words:
    """The words of some texts: hash, document index, byte range in the buffer."""

    def __init__(self, texts: list[str | None], in_word: np.ndarray = SPACED):
        parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() maps A-Z alone
        self.buffer = b"\n".join(parts) + b"\n"
        data = np.frombuffer(self.buffer, np.uint8)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], in_word[data]]).astype(np.int8)))
        self.start, self.end = edges[0::2], edges[1::2]  # the buffer ends in a separator, so ranges are closed
        up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(_LETTER[data] * up[: len(data)])])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, self.offsets)  # of each document, and one past the last
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(parts)), self.count)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, word index) of every run of `size` words; a shorter text that has words gives one run of all."""
        n = len(self.hash)
        by = constants(size, 23)
        with np.errstate(over="ignore"):
            if n >= size:
                h = self.hash[: n - size + 1] * by[0]
                for j in range(1, size):
                    h = h + self.hash[j : n - size + 1 + j] * by[j]
                whole = self.doc[: n - size + 1] == self.doc[size - 1 :]
                at = np.flatnonzero(whole)
                h, doc = mix(h[at] + U64(size)), self.doc[at]
            else:
                h, doc, at = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            short = np.flatnonzero((self.count > 0) & (self.count < size))
            if len(short):
                values = [np.sum(self.hash[self.first[d] : self.first[d + 1]] * by[: self.count[d]], dtype=U64) + U64(self.count[d]) for d in short]
                h, doc, at = np.concatenate([h, mix(np.array(values, U64))]), np.concatenate([doc, short]), np.concatenate([at, self.first[short]])
                order = np.argsort(doc, kind="stable")
                h, doc, at = h[order], doc[order], at[order]
        return h, doc, at
