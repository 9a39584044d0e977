"""Token ids of texts through a cache of the chunks between blanks.

Valid for tokenizers none of whose tokens reach across an ASCII blank, tab or line
end. Most chunks of a corpus repeat, so the library sees each of them
once per cache; the ids of a text are looked up with array operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np

Encode = Callable[[Sequence[str]], list[Sequence[int]]]
# Chunks kept per Python worker; from a fuller cache those met once go.
CACHED_CHUNKS = 500_000


class ChunkCache:
    def __init__(self, encode: Encode, pattern: str, limit: int = CACHED_CHUNKS):
        self.encode, self.find, self.limit = encode, re.compile(pattern).findall, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.limit // 2:
            return self.clear()
        names = np.array(list(self.place), object)[kept]
        self.place = dict(zip(names.tolist(), range(len(kept))))
        size = self.size[kept]
        first = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.start[kept] - first, size) + np.arange(int(size.sum()))]
        self.start, self.size, self.uses = first, size, np.zeros(len(kept), np.int64)

    def _places(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))

    def _learn(self, chunks: list[str]) -> None:
        found = self.encode(chunks)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        base = len(self.flat)
        self.place.update(zip(chunks, range(len(self.size), len(self.size) + len(chunks))))
        self.start = np.concatenate([self.start, base + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])

    def ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """All ids in one array, the ids' count of each text, the chunks and their count per text."""
        per_text = [self.find(t) for t in texts]
        chunks = [c for found in per_text for c in found]
        at = self._places(chunks)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(chunks[i] for i in missing.tolist()))
            if len(self.place) + len(new) > self.limit:
                self._shrink()
                at = self._places(chunks)
                missing = np.flatnonzero(at < 0)
                new = list(dict.fromkeys(chunks[i] for i in missing.tolist()))
            self._learn(new)
            at[missing] = self._places([chunks[i] for i in missing.tolist()])
        self.uses += np.bincount(at, minlength=len(self.uses))
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])
        counts = np.fromiter(map(len, per_text), np.int64, len(per_text))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[where], total[ends[1:]] - total[ends[:-1]], chunks, counts
