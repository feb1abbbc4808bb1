"""Per-word work on whole texts: each distinct word is worked on once for each Python worker.

Scores that add up over the words of a text need no more than a table of words; what a new word
needs (its n-grams, say) is computed for many new words at once, in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

REMEMBERED_CHARS = 4 << 20
#: New words that are worked on at once; what a word needs meanwhile is many times its row.
PORTION = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


class WordTable:
    """Rows of numbers by word.  ``compute`` gives the rows of new words; what is remembered is
    bounded by characters, and forgotten between batches."""

    def __init__(self, compute: Callable[[list], np.ndarray], width: int, most_chars: int = REMEMBERED_CHARS):
        self.compute, self.width, self.most_chars = compute, width, most_chars
        self.forget()

    def forget(self) -> None:
        self.place: dict = {}
        self.rows = np.zeros((1024, self.width), np.float64)
        self.chars = 0

    def ids(self, texts: Sequence[Sequence]) -> list[np.ndarray]:
        """For each list of words the places of its words in ``rows``."""
        if self.chars > self.most_chars:
            self.forget()
        fresh: set = set()
        for words in texts:
            fresh.update(set(words).difference(self.place))
        if fresh:
            new = sorted(fresh)
            start = len(self.place)
            need = start + len(new)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.width), np.float64)
                grown[:start] = self.rows[:start]
                self.rows = grown
            for a in range(0, len(new), PORTION):
                part = new[a : a + PORTION]
                self.rows[start + a : start + a + len(part)] = self.compute(part)
            self.place.update(zip(new, range(start, need), strict=True))
            self.chars += sum(map(len, new)) + 16 * len(new)
        get = self.place.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]


def codes(words: list[str], before: str, after: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the padded words in a row, the word of each, and each word's end."""
    padded = [before + w + after for w in words]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    flat = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(padded)), lengths)
    return flat, owner, np.repeat(np.cumsum(lengths), lengths)


def gram_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n code points from each place on (the last n - 1 places are void)."""
    h = np.full(len(flat), n, np.uint64)
    for k in range(n):
        h[: len(flat) - k] = (h[: len(flat) - k] ^ flat[k:]) * MIX
        h ^= h >> np.uint64(29)
    return h


def log_sum(values: np.ndarray) -> float:
    top = values.max()
    return float(top + np.log(np.exp(values - top).sum()))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the constant) of a small dense logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    ridge = l2 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w
