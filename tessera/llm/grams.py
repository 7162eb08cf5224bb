"""Vectorised hashes of words and word shingles, for many texts at once.

Words are runs of bytes other than white space (0x20, 0x09-0x0D) in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_R2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Texts are joined up to so many bytes at a time; a longer text is handled alone.
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def chunks(texts: Sequence[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) of runs of texts of about ``limit`` bytes."""
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if run and size + len(b) > limit:
            yield at, run
            at, size, run = i, 0, []
        run.append(b)
        size += len(b)
    if run:
        yield at, run


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in order, and the number of words of each text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    n = len(buf)
    up = powers(_R, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    down = powers(inverse(int(_R)), n)
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.diff(np.searchsorted(start, bounds))


def sequence_keys(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's sequence of words."""
    first = np.concatenate([[0], np.cumsum(counts)])
    rel = np.arange(len(words)) - np.repeat(first[:-1], counts)
    top = int(counts.max(initial=0)) + 1
    out = []
    for base in (_R, _R2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(words * powers(base, top)[rel])])
        out.append(mix(total[first[1:]] - total[first[:-1]] + mix(counts.astype(np.uint64) + base)))
    return out[0], out[1]


def shingles(words: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of n words, in order, with repeats, and their number. A text of fewer words, but
    not none, is one shingle."""
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(int(per.sum()))
    size = np.minimum(np.repeat(counts, per), n)
    acc = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(n, dtype=np.uint64)])
    for k in range(n):
        w = padded[at + k] if (size > k).all() else np.where(size > k, padded[at + k], np.uint64(0))
        acc = acc * _R2 + w
    return mix(acc), per
