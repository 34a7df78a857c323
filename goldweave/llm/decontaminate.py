"""Benchmark decontamination by greedy string tiling.

Runs of ``least`` words that a document and a benchmark item share are seeds,
found by a rolling hash over word hashes.  Seeds on one diagonal join to the
longest runs.  Tiling marks the longest run whose words are still free on both
sides, cuts the others, and repeats until no run of ``least`` words is left;
so passages are found in any order.  The share of an item's words under tiles
is its coverage, and ``threshold`` of it marks the document.

Karp-Rabin runs once, not once for each length: a match of n words is n -
``least`` + 1 seeds in a row on one diagonal and nothing else is, so the
longest runs of seeds are the longest matches of every length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm.durable import bound_batches
from goldweave.llm.words import U, hash_chunks, hash_texts, shingles

LEAST, THRESHOLD = 5, 0.6
#: Characters of benchmark text in one broadcast; a larger benchmark is searched in blocks of this size.
BLOCK_CHARS = 32 << 20
_MASK_BITS = 20
#: Pairs of equal seeds of a document and an item that are listed at once; more are joined row by row.
PAIRS = 1 << 21


class ItemIndex:
    """The seeds of a block of items; an item of fewer than ``least`` words is one seed, the whole of it."""

    def __init__(self, ids: list, texts: list, least: int) -> None:
        self.least, self.ids = least, ids
        self.words = [w for w in hash_texts(texts)]
        self.parts = [SeedTable([i for i, w in enumerate(self.words) if min(len(w), least) == n], self.words, n) for n in range(1, least + 1)]
        self.parts = [x for x in self.parts if len(x.seeds)]


class SeedTable:
    """The seeds of ``width`` words of some items, sorted."""

    def __init__(self, items: list[int], words: list[np.ndarray], width: int) -> None:
        self.width = width
        self.own = {i: shingles(words[i], width) for i in items}
        empty = np.empty(0, dtype=U)
        every = np.concatenate([self.own[i] for i in items]) if items else empty
        item = np.repeat(np.array(items, dtype=np.int64), [len(self.own[i]) for i in items])
        order = np.argsort(every, kind="stable")
        self.seeds, self.item = every[order], item[order]
        self.mask = np.zeros(1 << _MASK_BITS, dtype=bool)
        self.mask[(self.seeds & U((1 << _MASK_BITS) - 1)).astype(np.int64)] = True

    def held(self, seeds: np.ndarray) -> np.ndarray:
        """Places of those ``seeds`` that some item has."""
        at = np.flatnonzero(self.mask[(seeds & U((1 << _MASK_BITS) - 1)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.seeds, seeds[at]), len(self.seeds) - 1)
        return at[self.seeds[spot] == seeds[at]]

    def items_of(self, seeds: np.ndarray) -> np.ndarray:
        """The items that have one of the distinct ``seeds``."""
        low, high = (np.searchsorted(self.seeds, seeds, side) for side in ("left", "right"))
        return np.unique(np.concatenate([self.item[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])) if len(seeds) else np.empty(0, dtype=np.int64)


def runs(doc: np.ndarray, item: np.ndarray, least: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length in words, place in the document, place in the item) of the longest runs of equal seeds on one diagonal.

    ``doc`` and ``item`` are the seeds of both.  Few pairs of equal seeds are
    listed; many, as of texts that repeat themselves, are joined one place of
    the item after the other, so memory follows the document and the runs.
    """
    order = np.argsort(doc, kind="stable")
    low, high = (np.searchsorted(doc[order], item, side) for side in ("left", "right"))
    n = high - low
    if n.sum() <= pairs:
        spot = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        at, place = order[spot], np.repeat(np.arange(len(item)), n)
        by = np.lexsort((at, at - place))
        at, place = at[by], place[by]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(place) != 1)))[: len(at)])
        return np.diff(np.concatenate((new, [len(at)]))) + least - 1, at[new], place[new]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = len(doc)
    length, equal = np.zeros(size + 1, dtype=np.int32), doc == item[-1]
    for q in range(len(item) - 1, -1, -1):
        length[:size] = np.where(equal, length[1:] + 1, 0)
        length[size] = 0
        before = doc == item[q - 1] if q else np.zeros(size, dtype=bool)
        first = equal.copy()
        first[1:] &= ~before[:-1]
        p = np.flatnonzero(first)
        out.append((length[p].astype(np.int64) + least - 1, p, np.full(len(p), q)))
        equal = before
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def tile(found: tuple[np.ndarray, np.ndarray, np.ndarray] | list[tuple[int, int, int]], least: int, doc_words: int, item_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the document, place in the item); of equal lengths the first in the document.

    Ends when fewer words of the item are free than a tile has.
    """
    n, p, q = (np.asarray(x, dtype=np.int64) for x in (found if isinstance(found, tuple) else zip(*found, strict=True)))
    order = np.lexsort((q, p, -n))
    whole = iter(zip((-n[order]).tolist(), p[order].tolist(), q[order].tolist(), strict=True))
    used_doc, used_item = np.zeros(doc_words, dtype=bool), np.zeros(item_words, dtype=bool)
    cut: list[tuple[int, int, int]] = []  # what is left of runs that tiles cut
    tiles, free, following = [], item_words, next(whole, None)
    while free >= least and (cut or following is not None):
        if following is None or cut and cut[0] < following:
            n, p, q = heapq.heappop(cut)
        else:
            (n, p, q), following = following, next(whole, None)
        n = -n
        taken = used_doc[p : p + n] | used_item[q : q + n]
        if not taken.any():
            tiles.append((n, p, q))
            used_doc[p : p + n] = used_item[q : q + n] = True
            free -= n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for i, j in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if j - i >= least:
                heapq.heappush(cut, (i - j, p + i, q + i))
    return tiles


def contaminated(words: np.ndarray, index: ItemIndex, threshold: float) -> list[tuple[int, float, int, int, int, int]]:
    """(item number, coverage, tiles, longest tile, first and last covered word + 1) of items covered by ``threshold``."""
    out = []
    for part in index.parts:
        least = part.width
        if len(words) < least:
            continue
        seeds = shingles(words, least)
        at = part.held(seeds)
        own = np.unique(seeds[at])
        for i in part.items_of(own).tolist():
            mine, size = part.own[i], len(index.words[i])
            under = np.zeros(size + 1, dtype=np.int64)
            spot = np.flatnonzero(np.isin(mine, own))
            np.add.at(under, spot, 1), np.add.at(under, spot + least, -1)
            if (np.cumsum(under)[:size] > 0).sum() < threshold * size:
                continue  # tiles cover no more than all seeds together
            tiles = tile(runs(seeds, mine, least), least, len(words), size)
            covered = sum(n for n, _, _ in tiles)
            if covered >= threshold * size:
                out.append((int(i), covered / size, len(tiles), max(n for n, _, _ in tiles), min(p for _, p, _ in tiles), max(p + n for n, p, _ in tiles)))
    return out


def search_texts(texts: list, index: ItemIndex, threshold: float) -> Iterator[tuple[int, list]]:
    """(number of the text, what ``contaminated`` finds in it) for texts with a find.

    Seeds are looked up for many texts at once; a seed across two texts only
    costs a second look.
    """
    for first, words, cut in hash_chunks(texts):
        near = [np.empty(0, dtype=np.int64)]
        for part in index.parts:
            if len(words) >= part.width:
                near.append(part.held(shingles(words, part.width)))
        for i in np.unique(np.searchsorted(cut, np.concatenate(near), "right") - 1).tolist():
            found = contaminated(words[cut[i] : cut[i + 1]], index, threshold)
            if found:
                yield first + i, found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, least: int, block_chars: int) -> Iterator[ItemIndex]:
    """Indexes of the benchmark, each of a bounded size."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        rows = sorted((r["id"] or "", r["text"]) for r in block.collect())
        yield ItemIndex([r[0] for r in rows], [r[1] for r in rows], least)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: int = LEAST, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id (as text), coverage, n_tiles, longest, start_word, end_word.

    Words are those between white space, lower-cased for A-Z.  An item of
    fewer than ``least`` words is found where all of them follow one another.
    Null and empty texts and items hold nothing.  Null ids and repeated
    rows are searched like others; further columns are not read; texts of any
    length are searched whole.  Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for index in _blocks(benchmark, item_col, item_text_col, least, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], *x) for i, found in search_texts(batch.column(1).to_pylist(), shared.value, threshold) for x in found]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array([shared.value.ids[k] for k in cols[1]], pa.string()), pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[3:])],
                    ["doc_id", "item_id", "coverage", "n_tiles", "longest", "start_word", "end_word"],
                )

        part = texts.mapInArrow(search, "doc_id long, item_id string, coverage double, n_tiles long, longest long, start_word long, end_word long")
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: int = LEAST, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` in which no item is found; columns as they are."""
    spark = docs.sparkSession
    bound_batches(spark)
    at = docs.columns.index(text_col)
    for index in _blocks(benchmark, item_col, item_text_col, least, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = np.ones(len(batch), dtype=bool)
                stay[[i for i, _ in search_texts(batch.column(at).to_pylist(), shared.value, threshold)]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
