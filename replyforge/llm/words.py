"""Words of text batches as numpy arrays, for operators that work in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

# Characters of text taken at once: bounds the memory of a task, not the work.
BATCH_CHARACTERS = 4_000_000


def text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def portions(frames: Iterator[pd.DataFrame], text: str = "text", most: int = BATCH_CHARACTERS) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in pieces of about ``most`` characters; a longer text is a piece of its own."""
    for frame in frames:
        if len(frame) == 0:
            continue
        size = np.fromiter((len(t) if isinstance(t, str) else 0 for t in frame[text]), np.int64, len(frame)).cumsum()
        start = 0
        while start < len(frame):
            floor = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, floor + most, "right")))
            yield frame.iloc[start:end].reset_index(drop=True)
            start = end


class WordTable:
    """Distinct words of a batch: ``codes`` of all words in order, ``starts`` of each text, distinct ``words``."""

    def __init__(self, texts: list[bytes]):
        # bytes.split() splits at exactly the six ASCII white space characters.
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.split = split
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(self.starts[-1], dtype=object)
        for i, words in enumerate(split):
            flat[self.starts[i] : self.starts[i + 1]] = words
        self.codes, self.words = pd.factorize(flat)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for every word, computed once for each distinct one."""
        one = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        return one[self.codes] if len(one) else np.zeros(0, np.uint64)


def laid_out(ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``ids`` that ``order`` numbers, one after the other, and where each ends."""
    own = lengths[order]
    ends = np.cumsum(own)
    return ids[np.repeat(begins[order] - (ends - own), own) + np.arange(ends[-1])], ends


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers; equal inputs stay equal and others look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
