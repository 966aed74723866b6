"""Tokenising by distinct words, exactly as the tokenizers library does it.

Both vocabularies in use split a text before they merge: no token reaches from a word into the white space after it.
So a text is the chain of its words, each with the white space before it, and equal words have equal ids wherever
they stand; each distinct word is given to the library once.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import islice

import numpy as np
import regex

#: A word with the white space before it, or white space that ends the text. White space is Unicode's.
SPACED_WORD = regex.compile(r"\s*\S+|\s+")
#: Code points that Python's str.split() takes for white space and Unicode does not.
ODD = regex.compile("[\x1c-\x1f]")
#: A text that words alone would get wrong by a vocabulary that looks at their surroundings.
PROBE = "The Quick  brown fox's\njumps, over 12.5 (lazy) dogs. \u00c9t\u00e9 na\u00efve\u2014word  \u4f60\u597d THE quick, brown "
#: Distinct words that an encoder keeps.
KEPT = 600_000


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers on this machine."""
    from public_tokenizers import path

    return str(path(name))


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordEncoder:
    """Ids of texts by a vocabulary that drops white space and marks the end of each word; words seen before are looked up.

    The table of words is bounded: when it is full only its oldest third stays, which costs time and changes nothing else.
    """

    def __init__(self, path: str, kept: int = KEPT, end: str = "</w>"):
        self.tokenizer, self.known, self.kept = load(path), {}, kept
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(end)]] = True
        self.type = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        if self.encode(PROBE).tolist() != self._ids(PROBE).tolist():
            raise ValueError(f"{path}: not a vocabulary whose words are independent of the white space around them")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def _learn_plain(self, words: list[str]) -> None:
        """Words of letters alone: each is one word to the library, so many go in one string and part at their ends."""
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            ids = self._ids(" ".join(some))
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some):
                self._learn_any(some)
                continue
            raw, size = ids.tobytes(), self.type.itemsize
            for w, a, b in zip(some, [0, *cut.tolist()], cut.tolist(), strict=False):
                self.known[w] = raw[a * size : b * size]

    def _learn_any(self, words: list[str]) -> None:
        for w in words:
            self.known[w] = self._ids(w).tobytes()

    def _learn(self, words: list[str]) -> None:
        """A word that ends in one comma or stop after letters is that word and the sign."""
        known = self.known
        signed = [w for w in words if w[-1] in ",." and w[:-1].isalpha()]
        bare = dict.fromkeys(w for w in words if w.isalpha())
        bare.update(dict.fromkeys(x for w in signed if (x := w[:-1]) not in known))
        # Case is folded by the library itself; folding ASCII first lets a word's forms share one entry.
        folded = {w: w.lower() for w in bare if w.isascii() and not w.islower()}
        low = dict.fromkeys(folded.get(w, w) for w in bare)
        self._learn_plain([w for w in low if w not in known])
        for w, x in folded.items():
            known[w] = known[x]
        self._learn_any([w for w in {*words} - {*bare} - {*signed} if w not in known])
        for sign in {w[-1] for w in signed}:
            if sign not in known:
                self._learn_any([sign])
        for w in signed:
            known[w] = known[w[:-1]] + known[w[-1]]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null one is empty."""
        if len(self.known) > self.kept:
            # The words met first are the frequent ones.
            self.known = dict(islice(self.known.items(), self.kept // 3))
        known = self.known
        # White space of str.split() only: a text with one of the odd separators is encoded whole.
        words = [None if t and ODD.search(t) else (t or "").split() for t in texts]
        if new := [w for w in set().union(*filter(None, words)) if w not in known]:
            self._learn(new)
        return [self._ids(t) if w is None else np.frombuffer(b"".join(map(known.__getitem__, w)), self.type) for t, w in zip(texts, words, strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker process, with the words that its earlier tasks met."""
    return WordEncoder(path)
