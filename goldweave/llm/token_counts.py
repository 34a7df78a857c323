"""Exact token counts at every prefix of a text.

For a byte-level BPE the last token of the encoding of each prefix of a word
follows by dynamic programming: ``t`` is the last token of the prefix that ends
at ``i`` if it ends there and, together with the last token of the prefix
before it, is encoded as these two tokens; exactly one ``t`` does.  So

    count(i) = count(i - len(t)) + 1

Counts of a text are those of its words, added up, with three corrections for
prefixes that are split into words in another way than the whole text: inside
a run of white space, inside a contraction and inside a special token.
Truncation and budget questions are then look-ups in the counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.durable import bound_batches

#: Tokens that a document may have.
LIMIT = 512
# The word pattern of byte-level BPE, and its contractions of three characters.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
_RUNS = regex.compile(r"\s{2,}")
_CLASSES = {"a": regex.compile(r"\p{L}"), "1": regex.compile(r"\p{N}"), " ": regex.compile(r"\s"), "!": regex.compile(r"[^\s\p{L}\p{N}]")}


class PrefixCounter:
    """Counts tokens of every prefix (in code points) as the tokenizer of ``path`` does."""

    def __init__(self, path: str, capacity: int = 400_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        _refuse_others(told)
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = [x["content"] for x in told["added_tokens"]]
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.spelled = {i: s for i, s in enumerate(_spelling(pre_tokenizers))}
        of_char = {s: i for i, s in self.spelled.items()}
        #: Tokens by their bytes from last to first; key -1 holds the token.
        self.trie: dict = {}
        self.text_of: list[str] = [""] * self.tokenizer.get_vocab_size()
        for token, i in told["model"]["vocab"].items():
            node = self.trie
            for c in reversed(token):
                node = node.setdefault(of_char[c], {})
            node[-1] = i
            self.text_of[i] = token
        self.size, self.capacity = len(self.text_of), capacity
        self.pairs: dict[int, bool] = {}
        self.held: dict[str, bytes] = {}
        self.known: set[str] = set()
        self.other: set[str] = set()

    def _joins(self, before: int, token: int) -> bool:
        """Whether the two tokens' bytes are encoded as these two tokens (or one alone as itself, after -1)."""
        key = (before + 1) * self.size + token
        found = self.pairs.get(key)
        if found is None:
            text = self.text_of[token] if before < 0 else self.text_of[before] + self.text_of[token]
            found = [t.id for t in self.model.tokenize(text)] == ([token] if before < 0 else [before, token])
            if len(self.pairs) >= 4 * self.capacity:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _dynamic(self, data: bytes) -> list[int]:
        """Tokens of each prefix of the word ``data``, from 0 bytes to all."""
        last, count = [-1], [0]
        pairs, size, trie, joins = self.pairs, self.size, self.trie, self._joins
        for end in range(1, len(data) + 1):
            node, at = trie, end
            while True:
                at -= 1
                node = node.get(data[at])
                if node is None:
                    raise ValueError("the vocabulary lacks a byte")
                token = node.get(-1)
                if token is not None:
                    fits = pairs.get((last[at] + 1) * size + token)
                    if fits or (fits is None and joins(last[at], token)):
                        last.append(token)
                        count.append(count[at] + 1)
                        break
        return count

    def word(self, word: str) -> bytes:
        """Counts after each code point of one word, as little-endian int32."""
        found = self.held.get(word)
        if found is None:
            data = word.encode("utf-8")
            count = np.array(self._dynamic(data)[1:], dtype="<i4")
            if len(data) > len(word):
                raw = np.frombuffer(data, dtype=np.uint8)
                count = count[np.append((raw[1:] & 0xC0) != 0x80, True)]
            if word in _LONG_CONTRACTIONS:
                count[1] = 2  # its first two characters are no contraction but an apostrophe and a letter
            found = count.tobytes()
            if len(self.held) >= self.capacity:
                self.held.clear()
            if len(word) <= 64:
                self.held[word] = found
        return found

    def _words(self, text: str) -> list[str]:
        """The words of ``text``; the tokenizer splits it where it knows a character as of another class."""
        new = set(text) - self.known
        if new:
            for c in new:
                known = next(k for k, r in _CLASSES.items() if r.fullmatch(c))
                if len(self.split(known + c + known)) != 1:
                    self.other.add(c)
            self.known |= new
        if self.other and not self.other.isdisjoint(text):
            return [text[a:b] for _, (a, b) in self.split(text)]
        return _WORDS.findall(text)

    def _segment(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        get, word = self.held.get, self.word
        parts = [get(w) or word(w) for w in self._words(text)]
        count = np.frombuffer(b"".join(parts), dtype="<i4").astype(np.int32)
        length = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        whole = count[np.cumsum(length) - 1]
        count += np.repeat(np.cumsum(whole, dtype=np.int32) - whole, length)
        for run in _RUNS.finditer(text):
            a, b = run.span()
            count[a:b] = np.frombuffer(get(run[0]) or word(run[0]), dtype="<i4") + (count[a - 1] if a else 0)
        return count

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of the first 0, 1, ... code points of ``text``."""
        base, out = 0, [np.zeros(1, dtype=np.int32)]
        pieces = self.special.split(text or "") if self.special else [text or ""]
        for k in range(0, len(pieces), 2):
            if k + 1 < len(pieces):
                # A prefix that ends inside a special token holds ordinary characters.
                count = self._segment(pieces[k] + pieces[k + 1][:-1])
                whole = int(self._segment(pieces[k])[-1]) if pieces[k] else 0
                out += [base + count, np.array([base + whole + 1], dtype=np.int32)]
                base += whole + 1
            else:
                out.append(base + self._segment(pieces[k]))
        return np.concatenate(out).astype(np.int32)


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    """The counter of a Python worker; its tables serve all tasks that the worker runs."""
    return PrefixCounter(path)


def _spelling(pre_tokenizers: object) -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def _refuse_others(told: dict) -> None:
    model, split = told["model"], told.get("pre_tokenizer") or {}
    fits = (
        model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer")
        and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in told["added_tokens"])
    )
    if not fits:
        raise ValueError("prefix counts need a byte-level BPE that splits by the usual word pattern")


def prefix_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, counts (array<int>).

    ``counts[i]`` is the exact number of tokens of the first ``i`` code points,
    so it has one element more than the text has code points; ``tokens_at`` and
    ``longest_within`` answer questions from it.  A null text is empty.  Ids
    may be null or repeat; texts of any length are taken whole; further columns
    are not read; no rows give no rows.
    """
    return _counted(docs, tokenizer_path, id_col, text_col, None)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, fits_chars.

    The counts of all prefixes are made as for ``prefix_counts`` but stay in
    the task, which answers from them: ``fits_chars`` is the length in code
    points of the longest prefix of at most ``limit`` tokens.
    """
    return _counted(docs, tokenizer_path, id_col, text_col, limit)


def _counted(docs: DataFrame, path: str, id_col: str, text_col: str, limit: int | None) -> DataFrame:
    bound_batches(docs.sparkSession, 256)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            size = pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64())
            tables = (counter.prefixes(t) for t in texts)
            if limit is None:
                held = list(tables)
                total = pa.array([int(x[-1]) for x in held], pa.int64())
                offsets = np.cumsum([0, *map(len, held)]).astype(np.int32)
                values = pa.array(np.concatenate(held) if held else np.empty(0, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([ids, size, total, pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "n_bytes", "n_tokens", "counts"])
            else:
                found = [(int(x[-1]), int(np.flatnonzero(x <= limit)[-1])) for x in tables]
                total, fits = ([x[k] for x in found] for k in (0, 1))
                columns = [ids, size, pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_()), pa.array(fits, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    told = "doc_id long, n_bytes long, n_tokens long, " + ("counts array<int>" if limit is None else "over_limit boolean, fits_chars long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, told)


def tokens_at(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points; of the whole text where it has fewer."""
    at = chars if isinstance(chars, Column) else F.lit(chars)
    return F.get(counts, F.least(at, F.size(counts) - 1)).cast("long")


def longest_within(counts: Column, limit: Column | int) -> Column:
    """Code points of the longest prefix of at most ``limit`` tokens."""
    fits = F.transform(F.reverse(counts), lambda c: c <= limit)
    return (F.size(counts) - F.array_position(fits, F.lit(True))).cast("long")
