"""Word hashes of whole batches of texts, computed with array arithmetic.

A text is a run of code points; words are the maximal runs of word characters of the lower-cased text.
Each word gets a 64-bit hash that depends on its characters alone, so equal words have equal hashes in
every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Odd multipliers of the hashes.
MUL, MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Code points per batch; bounds the arrays of a task to some tens of MB, but for a longer single text.
BATCH_CHARS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _letters(unicode_words: bool) -> np.ndarray:
    """Which code points are word characters: letters and digits of Unicode, or A-Z a-z 0-9 and _."""
    if unicode_words:
        return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    out = np.zeros(0x110000, dtype=bool)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
    return out


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(MUL2), -1, 1 << 64))
    up, down = np.full(n, MUL2), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """Words of a batch: ``hashes``, ``starts`` and ``ends`` in ``text``; those of text i lie at ``first[i]:first[i+1]``."""

    def __init__(self, texts: list[str | None], unicode_words: bool):
        if unicode_words:
            low = [(t or "").lower() for t in texts]
        else:  # only A-Z have a lower case that counts
            low = [t or "" for t in texts]
        self.text = "\n".join(low) + "\n"
        code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not unicode_words:
            code = np.where((code >= 65) & (code <= 90), code + 32, code)
        inside = _letters(unicode_words)[code]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        up, down = _powers(1 << max(20, int(len(code)).bit_length()))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(code.astype(np.uint64) + MUL) * up[: len(code)], dtype=np.uint64)))
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        bounds = np.cumsum([0, *(len(t) + 1 for t in low)])
        self.first = np.searchsorted(self.starts, bounds)

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each word on, and whether these lie in one text."""
        n = len(self.hashes)
        out = np.zeros(max(0, n - k + 1), dtype=np.uint64)
        for j in range(k):
            out = out * MUL + self.hashes[j : j + len(out)]
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return mix(out), owner[: len(out)] == owner[k - 1 :] if len(out) else np.zeros(0, dtype=bool)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about BATCH_CHARS characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
