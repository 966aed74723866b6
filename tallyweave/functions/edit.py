"""Edit distances of texts to many at once, by bit-parallel columns (Myers; Hyyrö's form) on the prefixes they share."""

from __future__ import annotations

import numpy as np

#: Numbers in an array while columns are worked out, about: few enough to stay in a core's cache.
CELLS = 32_768


class Texts:
    """Texts as a tree of their prefixes: a column is worked out once for all texts that begin alike."""

    def __init__(self, texts: list[str]):
        #: Place of each sorted text among the texts as given.
        self.order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
        self.points = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in self.order.tolist()]
        self.sizes = np.array([len(p) for p in self.points], np.int64)
        letters, numbers = np.unique(np.concatenate(self.points) if texts else np.zeros(0, np.uint32), return_inverse=True)
        self.number = {chr(c): i for i, c in enumerate(letters.tolist())}
        starts, node, active = np.cumsum(self.sizes) - self.sizes, np.zeros(len(texts), np.int64), np.flatnonzero(self.sizes)
        #: By depth: the letter and the parent of each prefix, and the texts that end there with their prefixes.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(active):
            depth = len(self.levels)
            letter, parent = numbers[starts[active] + depth], node[active]
            new = np.ones(len(active), bool)
            new[1:] = (letter[1:] != letter[:-1]) | (parent[1:] != parent[:-1])
            node[active] = np.cumsum(new) - 1
            end = active[self.sizes[active] == depth + 1]
            self.levels.append((letter[new], parent[new], end, node[end]))
            active = active[self.sizes[active] > depth + 1]

    def distances(self, text: str) -> np.ndarray:
        """Edit distances of text to each of the texts, in the order in which they were given."""
        return self.of([text])[0]

    def of(self, texts: list[str]) -> np.ndarray:
        """The same for several texts, a row each."""
        found = np.empty((len(texts), len(self.sizes)), np.int64)
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= 64]
        step = max(1, CELLS // max((len(level[0]) for level in self.levels), default=1))
        for at in range(0, len(short), step):
            some = short[at : at + step]
            found[np.array(some)[:, None], self.order] = self._columns([texts[i] for i in some])
        for i in set(range(len(texts))) - set(short):
            found[i, self.order] = self._long(texts[i])
        return found

    def _columns(self, texts: list[str]) -> np.ndarray:
        one, sizes = np.uint64(1), np.array([len(t) for t in texts], np.int64)[:, None]
        last = (sizes - 1).astype(np.uint64)
        masks = np.zeros((len(texts), len(self.number)), np.uint64)
        for row, text in zip(masks, texts, strict=True):
            for i, c in enumerate(text):
                if c in self.number:
                    row[self.number[c]] |= one << np.uint64(i)
        plus, minus, far = np.full((len(texts), 1), ~np.uint64(0)), np.zeros((len(texts), 1), np.uint64), sizes
        out = np.repeat(sizes, len(self.sizes), 1)
        for letter, parent, end, node in self.levels:
            eq = masks[:, letter]
            if len(parent) != plus.shape[1] or (parent != np.arange(len(parent))).any():
                plus, minus, far = plus[:, parent], minus[:, parent], far[:, parent]
            xv, xh = eq | minus, (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            far = far + ((ph >> last) & one).view(np.int64) - ((mh >> last) & one).view(np.int64)
            ph, mh = (ph << one) | one, mh << one
            plus, minus = mh | ~(xv | ph), ph & xv
            if len(end):
                out[:, end] = far[:, node]
        return out

    def _long(self, text: str) -> np.ndarray:
        """The same with whole numbers of any length, text by text."""
        size, masks = len(text), {}
        for i, c in enumerate(text):
            masks[ord(c)] = masks.get(ord(c), 0) | 1 << i
        full, top, out = (1 << size) - 1, 1 << max(size - 1, 0), []
        for points in self.points:
            pv, mv, far = full, 0, size
            for letter in points.tolist() if size else ():
                eq = masks.get(letter, 0)
                xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | (full & ~(xh | pv)), pv & xh
                far += bool(ph & top) - bool(mh & top)
                ph, mh = (ph << 1) | 1, mh << 1
                pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
            out.append(far if size else len(points))
        return np.array(out, np.int64)
