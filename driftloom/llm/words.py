"""Token ids of texts, word by word."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Bytes of words and ids that a worker remembers, beside those of one block of text.
REMEMBERED = 256 << 20
#: What a word takes beside its letters and ids: its entry, its string, its end.
ENTRY = 160
#: Words that are tokenised in one call.
AT_ONCE = 50_000


class Shelf(dict):
    """Places of words in order of arrival, and the ids of each word in a row."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.known = self.letters = 0

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = place = len(self)
        return place

    def size(self) -> int:
        return self.known * ENTRY + 4 * self.letters + 4 * int(self.ends[self.known - 1] if self.known else 0)

    def add(self, ids: np.ndarray, sizes: np.ndarray, letters: int) -> None:
        """The ids of the next words that came without."""
        before = int(self.ends[self.known - 1]) if self.known else 0
        n = len(sizes)
        if len(self.ends) < self.known + n:
            self.ends = np.concatenate([self.ends, np.zeros(max(n, len(self.ends)), np.int64)])
        if len(self.ids) < before + len(ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(ids), len(self.ids)), np.uint32)])
        self.ids[before:before + len(ids)] = ids
        self.ends[self.known:self.known + n] = before + np.cumsum(sizes)
        self.known += n
        self.letters += letters

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at `places` in a row, and how many each has."""
        ends = self.ends[places]
        starts = np.where(places > 0, self.ends[places - 1], 0)
        sizes = ends - starts
        return self.ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


class WordIds:
    """Remembers the ids of words, so a word met not long before is not tokenised again.

    For tokenizers that never join what stands on both sides of a cut. By default
    texts are cut at spaces and line feeds, which are dropped. `encode_words`
    takes a list of words to their ids in a row and the number of each.

    Words stand on two shelves. When the newer holds half of REMEMBERED, the
    older is forgotten and a new one begun; a word found on the older one is
    taken over. So the words of late are known, and memory stays bounded by
    REMEMBERED and the words of one call.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], remembered: int | None = None):
        self.encode_words = encode_words
        self.most = (REMEMBERED if remembered is None else remembered) // 2
        self.now, self.before = Shelf(), Shelf()

    def cut(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def _learn(self) -> None:
        now, before = self.now, self.before
        words, now.new = now.new, []
        for lo in range(0, len(words), AT_ONCE):
            part = words[lo:lo + AT_ONCE]
            places = np.array([before.get(w, -1) for w in part], np.int64)
            old = places >= 0
            sizes = np.zeros(len(part), np.int64)
            kept, sizes[old] = before.at(places[old])
            strange = [w for w, known in zip(part, old.tolist()) if not known]
            found, sizes[~old] = self.encode_words(strange) if strange else (np.empty(0, np.uint32), 0)
            ids = np.empty(int(sizes.sum()), np.uint32)
            from_old = np.repeat(old, sizes)
            ids[from_old], ids[~from_old] = kept, found
            now.add(ids, sizes, sum(map(len, part)))

    def all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.now.size() > self.most:
            self.now, self.before = Shelf(), self.now
        cut = [self.cut(t) for t in texts]
        place = self.now.__getitem__
        places = np.fromiter(map(place, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        if self.now.new:
            self._learn()
        ids, sizes = self.now.at(places)
        ends = np.append(0, np.cumsum(sizes))[np.cumsum([0, *map(len, cut)])]
        return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
