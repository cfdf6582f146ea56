"""Words of many texts as numbers, for vectorised work inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from factfade.llm.tokens import SLICE_CHARS, text_slices


class Words:
    """Texts cut at white space: ``vocabulary``, ``codes`` of all words in order, and
    the text (``doc``) that each word belongs to."""

    def __init__(self, texts: list[str], lower: bool = False):
        known: dict[str, int] = {}
        codes: list[int] = []
        counts = []
        give = known.setdefault
        for text in texts:
            words = (text.lower() if lower else text).split()
            codes += [give(w, len(known)) for w in words]
            counts.append(len(words))
        self.vocabulary = list(known)
        self.codes = np.array(codes, np.int64)
        self.counts = np.array(counts, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each text."""
        return np.bincount(self.doc, weights=values, minlength=len(self.counts))


def word_slices(
    texts: list[str | None], lower: bool = False, most: int = SLICE_CHARS
) -> Iterator[tuple[int, Words]]:
    for first, some in text_slices(texts, most):
        yield first, Words(some, lower)


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from any (a public finalizer of multiply and shift)."""
    out = values.astype(np.uint64)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(33)
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive numbers."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - size + 1, np.uint64)
    for k in range(size):
        out = out * _BASE + values[k : len(values) - size + 1 + k]
    return mixed(out + np.uint64(size))


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array(
        [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7) for w in words], np.uint64
    )


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of ``<word>`` one after the other, number of the word of each)."""
    whole = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    return points, np.repeat(np.arange(len(words)), lengths)
