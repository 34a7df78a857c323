"""The cosines and BM25 of pairs of titles, from the left title's terms and how many titles hold each.

A term counts only where both titles hold it, so the right one brings no terms
of its own: its text and three lengths are all that travels with a pair.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

K1, B = 1.5, 0.75


@lru_cache(1 << 16)
def _grams(word: str) -> tuple[str, ...]:
    """As ``text.char_ngrams`` of one word."""
    padded = f" {word} "
    return tuple(padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1))


@lru_cache(1 << 14)
def _parsed(title: str) -> tuple[dict[str, int], dict[str, int], int]:
    """The words and the word n-grams of a title with their numbers, and how many words it has."""
    words = [w for w in title.split(" ") if w]
    long = [w for w in words if len(w) > 1]
    return Counter(words), Counter(long + [f"{a} {b}" for a, b in zip(long, long[1:])]), len(words)


class Title:
    """The weights of a title's terms; ``held`` has the counts of titles in the order of ``features.pieces``."""

    def __init__(self, title: str, held: list[int], n: int, avg_len: float) -> None:
        self.words, self.terms, self.size = _parsed(title)
        self.n, self.avg_len = n, avg_len
        tfidf = lambda df: math.log((1.0 + n) / (1 + df)) + 1 if df else 0.0
        chars, word_idf, self.idf, at = Counter(), {}, {}, 0
        char_idf: dict[str, float] = {}
        for w, tf in self.words.items():
            df = held[at]
            self.idf[w] = math.log(1 + (n - df + 0.5) / (df + 0.5)) if df else 0.0
            word_idf[w] = tfidf(held[at + 1])
            at += 2
            for g in _grams(w):
                if g not in char_idf:
                    char_idf[g] = tfidf(held[at])
                chars[g] += tf
                at += 1
        for t in self.terms:
            if t not in self.words:
                word_idf[t] = tfidf(held[at])
                at += 1
        self.char_norm = math.sqrt(sum((tf * char_idf[g]) ** 2 for g, tf in chars.items()))
        self.word_norm = math.sqrt(sum((tf * word_idf[t]) ** 2 for t, tf in self.terms.items()))
        self.own = sum(tf * self.weight(w, tf, self.size) for w, tf in self.words.items())
        self.chars = {g: tf * char_idf[g] ** 2 for g, tf in chars.items()}
        self.weights = {t: tf * word_idf[t] ** 2 for t, tf in self.terms.items()}
        self._met: dict[str, float] = {}

    def weight(self, word: str, tf: int, size: int) -> float:
        """The score that one occurrence of the word finds in a title of ``size`` words that holds it ``tf`` times."""
        return self.idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(self.avg_len, 1e-9)))

    def _of_word(self, word: str) -> float:
        found = self._met.get(word)
        if found is None:
            found = self._met[word] = sum(self.chars.get(g, 0.0) for g in _grams(word))
        return found

    def against(self, title: str, char_norm: float, word_norm: float, own: float) -> tuple[float, float, float]:
        """Both cosines and BM25 with another title of these lengths."""
        words, terms, size = _parsed(title)
        char = sum(tf * self._of_word(w) for w, tf in words.items())
        word = sum(tf * self.weights[t] for t, tf in terms.items() if t in self.weights)
        both = sum(self.words[w] * self.weight(w, tf, size) + tf * self.weight(w, self.words[w], self.size) for w, tf in words.items() if w in self.words)
        bm25 = max(0.0, min(1.0, both / (2 * max(self.own, own, 1e-9))))
        return char / (self.char_norm * char_norm) if char else 0.0, word / (self.word_norm * word_norm) if word else 0.0, bm25


def lengths(batches: Iterator[pa.RecordBatch], *, n: int, avg_len: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, title_norm, char_norm, word_norm, own) of titles (id, title_norm, held)."""
    for b in batches:
        made = [Title(t or "", h, n, avg_len) for t, h in zip(b["title_norm"].to_pylist(), b["held"].to_pylist(), strict=True)]
        columns = [b["id"], b["title_norm"], *[pa.array([getattr(t, c) for t in made], pa.float64()) for c in ("char_norm", "word_norm", "own")]]
        yield pa.RecordBatch.from_arrays(columns, schema.names).cast(schema)


def similarities(batches: Iterator[pa.RecordBatch], *, n: int, avg_len: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(l_id, r_id, char, word, bm25) of pairs with the left title's counts and the right one's lengths; a left title that follows itself is weighed once."""
    last, left = object(), None
    for b in batches:
        held, found = b["held"], []
        rights = zip(*(b[c].to_pylist() for c in ("r_title", "char_norm", "word_norm", "own")), strict=True)
        for i, (l_id, title, right) in enumerate(zip(b["l_id"].to_pylist(), b["l_title"].to_pylist(), rights, strict=True)):
            if l_id != last:
                last, left = l_id, Title(title or "", held[i].as_py(), n, avg_len)
            found.append(left.against(right[0] or "", *right[1:]))
        columns = [b["l_id"], b["r_id"], *(pa.array(v, pa.float64()) for v in (zip(*found, strict=True) if found else ([], [], [])))]
        yield pa.RecordBatch.from_arrays(columns, schema.names).cast(schema)
