"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles.  For one hash function, the
runs of tokens that share a minimum at place c are all runs inside one window
(l, c, r): the interval of c in the Cartesian tree of the hash values.  Only
windows of a passage's length count, so a text of n tokens has about
2 n / width of them.

1. A scan counts, for every hash function and minimum, whether more than one
   document has a window with it; partial counts are combined before the
   shuffle.  A Bloom filter over these shared minima then lets a second scan
   emit few windows besides the shared ones.
2. Windows with one minimum link to the window of the smallest document (a
   star, never all pairs).  For each pair of documents the windows' intervals
   are joined along diagonals; where at least ``agree`` hash functions meet on
   intervals that overlap, or one does whose next words on one side are equal,
   the words themselves are compared, and what is similar enough is a passage.
3. A star's centre may share less than the passage with some that share it
   with each other.  So all texts meet once more by runs of 36 words (of 15 in
   a row the least, so that every 50 words hold one), where either side lies in
   no passage yet, and what then is left by each run of 50 words.  Whoever
   shares such a run shares a passage, so the star loses no exact repeat, and
   the work stays in proportion to the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm import bloom
from goldweave.llm.durable import bound_batches, durable, forget
from goldweave.llm.skew import with_hot
from goldweave.llm.words import Runs, U, constants, hash_chunks, hash_texts, shingles, splitmix

K, PASSAGE, HASHES, AGREE, THRESHOLD = 5, 50, 4, 2, 0.8
#: Documents that one task compares with a copy of their centre.
BLOCK = 256
#: How far diagonals of one passage may differ, and how many words may differ in a row inside it.
DRIFT, GAP = 12, 10
#: Words that are set at once where runs lie on several diagonals.
_CELLS = 1 << 20
#: Bits of a place for the reach of its window on either side, and for its hash function.
_REACH, _OF = 12, 4
#: The hash function of anchors that are exact runs of words.
_EXACT = 15
#: Words by which the runs that stand for passages are shorter; of as many and one in a row one is taken.
SPARE = 14
PASSAGES = "doc_id long, start_word long, end_word long, other_id long, other_start long, other_end long, n_words long, similarity double"


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost minimum of each run of ``width`` values, by prefix and suffix minima of blocks.

    The place takes the lowest bits of its value, which then order ties; the
    bits above stay far more than a text has values.
    """
    n = len(values)
    bits = U(n.bit_length())
    keys = ((values >> bits) << bits) | np.arange(n, dtype=U)
    pad = -n % width
    if pad:
        keys = np.concatenate((keys, np.full(pad, ~U(0))))
    grid = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (low & ((U(1) << bits) - U(1))).astype(np.int64)


def smaller_neighbours(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest one to its left in its group that is not larger, else -1.

    Every value points at its neighbour first; one that points at a larger
    value takes over that one's pointer, until none does.
    """
    to = np.arange(-1, len(values) - 1, dtype=np.int64)
    to[np.concatenate(([True], group[1:] != group[:-1]))[: len(values)]] = -1
    live = np.flatnonzero(to >= 0)
    while len(live):
        live = live[values[to[live]] > values[live]]
        to[live] = to[to[live]]
        live = live[to[live] >= 0]
    return to


def compact_windows(values: np.ndarray, width: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian trees' nodes whose interval holds ``width`` values or more.

    ``starts`` are the places where texts begin, and the end; no window goes
    across.  A node's smaller neighbours have wide intervals themselves, so
    only minima of runs need to be compared.  Of equal values that follow one
    another within a run only the first is a node.
    """
    n = len(values)
    starts = np.array([0, n]) if starts is None else starts
    empty = np.empty(0, dtype=np.int64)
    if n < width:
        return empty, empty, empty
    spot = window_minima(values, width)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    c = spot[whole]
    c = c[np.concatenate(([True], c[1:] != c[:-1]))] if len(c) else c
    if not len(c):
        return empty, empty, empty
    group = text[c]
    again = np.concatenate(([False], (values[c[1:]] == values[c[:-1]]) & (np.diff(c) < width) & (group[1:] == group[:-1])))
    c, group = c[~again], group[~again]
    v = values[c]
    to = smaller_neighbours(v, group)
    left = np.where(to >= 0, c[to] + 1, starts[group])
    # From the right a value gives way only to a smaller one, so that ties belong to the first.
    back = smaller_neighbours_right(v, group)
    right = np.where(back < len(c), c[np.minimum(back, len(c) - 1)], starts[group + 1]) - 1
    wide = right - left + 1 >= width
    return left[wide], c[wide], right[wide]


def smaller_neighbours_right(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each value the index of the nearest one to its right in its group that is smaller, else their number."""
    n = len(values)
    to = np.arange(1, n + 1, dtype=np.int64)
    to[np.concatenate((group[1:] != group[:-1], [True]))[:n]] = n
    live = np.flatnonzero(to < n)
    while len(live):
        live = live[values[to[live]] >= values[live]]
        to[live] = to[to[live]]
        live = live[to[live] < n]
    return to


def _side(passage: int, k: int) -> int:
    """Words beside a minimum of which a repeat of a passage's length holds as many on one side."""
    return (passage - k) // 2 - 2


def _windows(texts: list, hashes: int, k: int, passage: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(numbers of the texts, minima, l, c, r, places among all words, ends of the texts there, hash function, runs of all words) of the windows of many texts.

    Minima differ between hash functions.
    """
    scale, shift, tag = constants(hashes, 51), constants(hashes, 53), constants(hashes, 57)
    width = passage - k + 1
    for first, words, cut in hash_chunks(texts):
        if len(words) < passage:
            continue
        tokens = shingles(words, k)
        # Texts of fewer than k words have no tokens; those that cross into the next text belong to no text.
        size = np.maximum(np.diff(cut) - k + 1, 0)
        keep = np.repeat(cut[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        tokens = tokens[keep]
        starts = np.concatenate(([0], np.cumsum(size)))
        runs = Runs(words)
        for h in range(hashes):
            left, c, right = compact_windows(tokens * scale[h] + shift[h], width, starts)
            if len(c):
                i = np.searchsorted(starts, c, "right") - 1
                yield first + i, splitmix(tokens[c] ^ tag[h]), left - starts[i], c - starts[i], right - starts[i], cut[i] + c - starts[i], cut[i + 1], h, runs


def _place(c: np.ndarray, before: np.ndarray, after: np.ndarray, h: int) -> np.ndarray:
    """A window's place, reach to either side and hash function in one number."""
    most = (1 << _REACH) - 1
    return (((c << _REACH | np.minimum(before, most)) << _REACH | np.minimum(after, most)) << _OF) | h


def _unplace(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """(c, l, r, hash function) of places."""
    most = (1 << _REACH) - 1
    c = p >> (_OF + 2 * _REACH)
    return c, c - (p >> (_OF + _REACH) & most), c + (p >> _OF & most), p & ((1 << _OF) - 1)


def _minima(hashes: int, k: int, passage: int):
    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, v, *_ in _windows(batch.column(1).to_pylist(), hashes, k, passage):
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(ids[i])], ["low", "doc"])

    return minima


def _sides(runs: Runs, at: np.ndarray, c: np.ndarray, end: np.ndarray, k: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the minimum with the words before and after it, 0 where the text has fewer."""
    side = _side(passage, k)
    before = np.where(c >= side, runs.at(at - side, side + k) ^ U(1), U(0))
    after = np.where(at + k + side <= end, runs.at(at, side + k), U(0))
    return before.view(np.int64), after.view(np.int64)


def _shared_windows(hashes: int, k: int, passage: int, bits: object):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, v, left, c, right, at, end, h, runs in _windows(batch.column(1).to_pylist(), hashes, k, passage):
                may = np.flatnonzero(bloom.may_hold(bits.value, v.view(np.int64)))
                before, after = _sides(runs, at[may], c[may], end[may], k, passage)
                place = _place(c[may], (c - left)[may], (right - c)[may], h)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v[may].view(np.int64), ids[i[may]], place, before, after)], ["low", "doc", "place", "before", "after"])

    return windows


def _runs(passage: int, spare: int, wanted: object | None, near: object | None = None):
    """(key, doc, place) of runs of ``passage - spare`` words; of each ``spare + 1`` runs in a row the least is taken.

    So every ``passage`` words hold one that is taken, the same wherever they
    occur.  ``wanted`` and ``near`` are filters of keys: the first one of the
    keys to take, the second one of the shorter runs of which one has to lie
    in the run.
    """
    length = passage - spare

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, words, cut in hash_chunks(batch.column(1).to_pylist()):
                if len(words) < length:
                    continue
                held = Runs(words)
                spot = np.arange(len(words) - length + 1)
                key = held.at(spot, length) ^ U(length)
                text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                inside = text[spot] == text[spot + length - 1]
                take = inside
                if spare:
                    # Runs across two texts count as the largest, so that texts alone decide.
                    every = np.full(len(key) + 2 * spare, ~U(0))
                    every[spare : spare + len(key)] = np.where(inside, key, ~U(0))
                    least = np.lib.stride_tricks.sliding_window_view(every, spare + 1).min(axis=1)
                    take = inside & np.any([least[d : d + len(key)] == key for d in range(spare + 1)], axis=0)
                if wanted is not None:
                    take = take & bloom.may_hold(wanted.value, key.view(np.int64))
                if near is not None:
                    short = held.at(np.arange(len(words) - length + SPARE + 1), length - SPARE) ^ U(length - SPARE)
                    upto = np.concatenate(([0], np.cumsum(bloom.may_hold(near.value, short.view(np.int64)))))
                    take = take & (upto[spot + SPARE + 1] > upto[spot])
                m = np.flatnonzero(take)
                if len(m):
                    of = text[m]
                    place = _place(m - cut[of], np.zeros(len(m), dtype=np.int64), np.full(len(m), length - K), _EXACT)
                    yield pa.RecordBatch.from_arrays([pa.array(key[m].view(np.int64)), pa.array(ids[first + of]), pa.array(place)], ["key", "doc", "place"])

    return runs


def _word_arrays(texts: list) -> list[bytes]:
    return [w.astype(np.uint32).tobytes() for w in hash_texts(texts)]


def _similarity(a: np.ndarray, b: np.ndarray, k: int) -> float:
    if len(a) == len(b) and (a == b).all():
        return 1.0
    x, y = np.unique(shingles(a.astype(U), k)), np.unique(shingles(b.astype(U), k))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


class Shingled:
    """The words of a text, its shingles, and their order."""

    def __init__(self, words: np.ndarray, k: int) -> None:
        self.words = words
        self.shingles = shingles(words.astype(U), k) if len(words) >= k else np.empty(0, dtype=U)
        self.order: np.ndarray | None = None

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the shingles in order, their values, and where in that order the equal ones begin."""
        if self.order is None:
            self.order = np.argsort(self.shingles, kind="stable")
            self.values = self.shingles[self.order]
            new = np.concatenate(([True], self.values[1:] != self.values[:-1]))[: len(self.order)]
            self.begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            self.many = np.bincount(self.begin, minlength=len(new))
            self.keys = self.begin * (len(new) + 1) + self.order
            # The place before each one that holds the same shingle, else -1.
            self.earlier = np.full(len(new), -1, dtype=np.int64)
            again = np.flatnonzero(~new)
            self.earlier[self.order[again]] = self.order[again - 1]
        return self.order, self.values, self.begin


class Compared:
    """Two texts, and for each shingle of the first one where the second one's order has it and how often."""

    def __init__(self, own: Shingled, other: Shingled, k: int) -> None:
        self.own, self.other, self.k = own, other, k
        _, values, _ = other.sorted()
        self.first = np.minimum(np.searchsorted(values, own.shingles), len(values) - 1)
        self.n = np.where(values[self.first] == own.shingles, other.many[self.first], 0)

    def _upto(self, at: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Where in the second text's order its equals of the shingles ``at`` reach ``place``."""
        size = len(self.other.shingles)
        return np.searchsorted(self.other.keys, self.first[at] * (size + 1) + np.clip(place, 0, size))

    def matches(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, diagonal) of the equal shingles of both texts, in order of places; of texts that repeat themselves only on diagonals from ``low`` to ``high``."""
        first, n = self.first, self.n
        at = np.flatnonzero(n)
        if n.sum() > 4 * (len(first) + len(self.other.order)) + 1024:
            first = self._upto(at, at - high)
            n = self._upto(at, at - low + 1) - first
        else:
            first, n = first[at], n[at]
        at = np.repeat(at, n)
        spot = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(at))
        return at, at - self.other.order[spot]

    def similarity(self, s: int, e: int, lo: int, hi: int) -> float:
        """``_similarity`` of the words from ``s`` to ``e`` and from ``lo`` to ``hi``, counted on the texts' shingles."""
        a, b = self.own.words[s:e], self.other.words[lo:hi]
        if min(len(a), len(b)) < self.k:
            return _similarity(a, b, self.k)
        if len(a) == len(b) and (a == b).all():
            return 1.0
        e, hi = e - self.k + 1, hi - self.k + 1
        self.own.sorted()
        mine = np.flatnonzero(self.own.earlier[s:e] < s) + s
        theirs = np.count_nonzero(self.other.earlier[lo:hi] < lo)
        both = mine[self.n[mine] > 0]
        if (self.n[both] > 1).any():
            common = np.count_nonzero(self._upto(both, lo) < self._upto(both, hi))
        else:
            place = self.other.order[self.first[both]]
            common = np.count_nonzero((place >= lo) & (place < hi))
        return common / (len(mine) + theirs - common)


def _regions(anchors: list[tuple[int, int, int, int, int, int, int]], k: int, agree: int) -> list[tuple[int, int, int, int]]:
    """(start, end, lowest, highest diagonal) where windows of ``agree`` hash functions, or one that needs no other, overlap on nearby diagonals."""
    spans = sorted((c - oc, c - min(c - lo, oc - olo), c + min(hi - c, ohi - oc) + k, h) for c, lo, hi, oc, olo, ohi, h in anchors)
    runs: list[list] = []
    for shift, start, end, h in spans:
        if runs and runs[-1][0] == shift and start < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], end)
            runs[-1][3].add(h)
        else:
            runs.append([shift, start, end, {h}])
    found: list[tuple[int, int, int, int, set]] = []
    for shift, start, end, of in runs:
        low = high = shift
        rest = []
        for g in found:
            if start < g[1] and end > g[0] and g[2] - DRIFT <= high and g[3] + DRIFT >= low:
                start, end, low, high, of = min(start, g[0]), max(end, g[1]), min(low, g[2]), max(high, g[3]), of | g[4]
            else:
                rest.append(g)
        found = [*rest, (start, end, low, high, of)]
    return [g[:4] for g in found if -1 in g[4] or len(g[4]) >= agree]


def passages_of_pair(
    own: Shingled, other: Shingled, anchors: list[tuple[int, int, int, int, int, int, int]], *, k: int = K, passage: int = PASSAGE, threshold: float = THRESHOLD, agree: int = AGREE
) -> list[tuple[int, int, int, int, float]]:
    """(start, end, other start, other end, similarity) of the passages to which anchors lead.

    ``anchors`` are (c, l, r) of a window in each document, and their hash
    function, or -1 if the words beside it are equal too.  Windows on nearby
    diagonals that overlap form one region.  A region of ``agree`` hash
    functions, or with an anchor of -1, goes on as far as equal shingles on
    diagonals within ``DRIFT`` follow one another within a passage's length.
    Inside it words that agree on one of these diagonals form runs; runs join
    over short gaps while the passage stays similar enough.
    """
    found: dict[tuple[int, int], tuple[int, int, int, int, float]] = {}
    regions = sorted(_regions(anchors, k, agree), key=lambda g: g[0] - g[1])
    if not regions or not len(own.shingles) or not len(other.shingles):
        return []
    pair = Compared(own, other, k)
    at, on = pair.matches(min(g[2] for g in regions) - DRIFT, max(g[3] for g in regions) + DRIFT)
    done: list[tuple[int, int, int, int]] = []
    for start, end, low, high in regions:
        if any(start >= x and end <= y and low >= lo and high <= hi for x, y, lo, hi in done):
            continue
        near = np.flatnonzero((on >= low - DRIFT) & (on <= high + DRIFT))
        place = at[near]
        if not len(place):
            continue
        cut = np.flatnonzero(np.diff(place) > passage) + 1
        first = int(np.searchsorted(place, start))
        part = int(np.searchsorted(cut, min(first, len(place) - 1), "right"))
        x, y = (int(cut[part - 1]) if part else 0), (int(cut[part]) if part < len(cut) else len(place))
        if place[x] >= end or place[y - 1] < start:
            continue
        a, b = int(place[x]), min(len(own.words), int(place[y - 1]) + k)
        shifts = on[near[x:y]]
        done.append((min(a, start), max(b, end), int(shifts.min()), int(shifts.max())))
        _align(pair, a, b, place[x:y], shifts, passage, threshold, found)
    return sorted(found.values())


def _where(pair: Compared, a: int, b: int, at: np.ndarray, on: np.ndarray) -> np.ndarray:
    """For each word from ``a`` to ``b`` its place in the other text on the diagonal where it lies in the longest run of equal words, else -1.

    ``at`` and ``on`` are the equal shingles.  Of several diagonals only runs of
    shingles count, and of equally long ones the lowest.
    """
    where = np.full(b - a, -1, dtype=np.int64)
    shift = int(on[0])
    if (on == shift).all():
        lo, hi = max(a, shift), min(b, len(pair.other.words) + shift)
        same = np.flatnonzero(pair.own.words[lo:hi] == pair.other.words[lo - shift : hi - shift]) + lo
        where[same - a] = same - shift
        return where
    # Equal shingles that follow one another on a diagonal are a run; longer ones are set later.
    by = np.lexsort((at, on))
    at, on = at[by], on[by]
    edge = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1] + 1) | (on[1:] != on[:-1])) + 1))
    size = np.diff(edge, append=len(at)) + pair.k - 1
    start, shift = at[edge], on[edge]
    by = np.lexsort((-shift, size))
    cells = np.cumsum(size[by])
    for part in np.split(by, np.searchsorted(cells, np.arange(_CELLS, cells[-1], _CELLS))):
        n = size[part]
        spot = np.repeat(start[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        where[spot - a] = spot - np.repeat(shift[part], n)
    return where


def _align(pair: Compared, a: int, b: int, at: np.ndarray, on: np.ndarray, passage: int, threshold: float, found: dict) -> None:
    """Adds the passages between ``a`` and ``b`` along the diagonals of the equal shingles to ``found``."""
    k, where = pair.k, _where(pair, a, b, at, on)
    agree = where >= 0
    if not agree.any():
        return
    edge = np.flatnonzero(np.diff(np.concatenate(([False], agree, [False])).astype(np.int8)))
    runs = list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))
    joined: list[tuple[int, int]] = []
    for s, e in runs:
        if joined and s - joined[-1][1] <= GAP and (e - s >= k or joined[-1][1] - joined[-1][0] >= k):
            joined[-1] = (joined[-1][0], e)
        elif e - s >= k:
            joined.append((s, e))
    for s, e in joined:
        for s1, e1, lo, hi, value in _similar_parts(pair, where, runs, a, s, e, passage, threshold):
            found[(a + s1, lo)] = (a + s1, a + e1, lo, hi, value)


def _similar_parts(pair: Compared, where: np.ndarray, runs: list, a: int, s: int, e: int, passage: int, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(start, end, other start, other end, similarity) of the whole joined stretch if it is similar enough, else of its longest halves that are."""
    if e - s < passage:
        return
    lo, hi = int(where[s]), int(where[e - 1]) + 1
    if hi > lo and (value := pair.similarity(a + s, a + e, lo, hi)) >= threshold:
        yield s, e, lo, hi, value
        return
    inside = [(x, y) for x, y in runs if x >= s and y <= e]
    gaps = [(inside[i + 1][0] - inside[i][1], i) for i in range(len(inside) - 1)]
    if not gaps:
        return
    _, cut = max(gaps)
    yield from _similar_parts(pair, where, runs, a, s, inside[cut][1], passage, threshold)
    yield from _similar_parts(pair, where, runs, a, inside[cut + 1][0], e, passage, threshold)


def _verifier(k: int, passage: int, threshold: float, agree: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            docs, reps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places = [batch.column(2).flatten().field(n).to_numpy(zero_copy_only=False) for n in range(3)]
            cut = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            for n, (doc, rep) in enumerate(zip(docs, reps, strict=True)):
                p, o, beside = (x[cut[n] : cut[n + 1]] for x in places)
                (c, left, right, h), (oc, oleft, oright, _) = _unplace(p), _unplace(o)
                h = np.where(beside | (h == _EXACT), -1, h)
                spots = list(zip(*(x.tolist() for x in (c, left, right, oc, oleft, oright, h)), strict=True))
                x = Shingled(np.frombuffer(batch.column(3)[n].as_buffer(), dtype=np.uint32), k)
                # Rows of one centre follow one another.
                theirs = batch.column(4)[n].as_buffer()
                if held is None or held[0] != rep or not theirs.equals(held[1]):
                    held = (rep, theirs, Shingled(np.frombuffer(theirs, dtype=np.uint32), k))
                for s, e, s2, e2, value in passages_of_pair(x, held[2], spots, k=k, passage=passage, threshold=threshold, agree=agree):
                    out.append((doc, s, e, rep, s2, e2, e - s, value))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.float64())], [x.split()[0] for x in PASSAGES.split(", ")])

    return verify


def _verified(texts: DataFrame, pairs: DataFrame, k: int, passage: int, threshold: float, agree: int) -> DataFrame:
    """The passages of ``pairs(doc, rep, anchors)``; a rep of many pairs is copied once for each block of them."""
    ids = pairs.select("doc").union(pairs.select(F.col("rep").alias("doc"))).distinct()
    own = durable(bloom.of_ids(texts, ids, _word_arrays, "doc long, own binary").dropDuplicates(["doc", "own"]), "words")
    degree = pairs.groupBy("rep").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("copies"))
    centres = own.join(degree, own.doc == degree.rep).select("rep", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("own").alias("other"))
    members = pairs.join(degree, "rep").select("doc", "rep", "anchors", F.expr("cast(pmod(xxhash64(doc), copies) as int)").alias("salt"))
    joined = members.join(own, "doc").join(centres, ["rep", "salt"]).select("doc", "rep", "anchors", "own", "other")
    found = durable(joined.mapInArrow(_verifier(k, passage, threshold, agree), PASSAGES), "passages")
    forget(own)
    return found


_ANCHOR = ("place", "other", "beside")


def _covers(found: DataFrame) -> DataFrame:
    """(doc, covers): where passages lie in documents, on either side, and the document that is their centre."""
    mine = found.select(F.col("doc_id").alias("doc"), "start_word", "end_word", F.col("other_id").alias("centre"))
    every = mine.union(found.select("other_id", "other_start", "other_end", "other_id"))
    return every.groupBy("doc").agg(F.collect_set(F.struct("start_word", "end_word", "centre")).alias("covers"))


def _held(rows: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """``rows(doc, place, ...)`` with ``held``: the centres of the passages that hold the ``length`` words from their place.

    Rows that have ``held`` already keep what is there.
    """
    c = F.shiftright("place", _OF + 2 * _REACH)
    none = F.array().cast("array<long>")
    inside = F.transform(F.filter("covers", lambda x: (x["start_word"] <= c) & (x["end_word"] >= c + length)), lambda x: x["centre"])
    known = F.col("held") if "held" in rows.columns else none
    return rows.join(_covers(found).hint("merge"), "doc", "left").withColumn("held", F.array_distinct(F.concat(known, F.coalesce(inside, none)))).drop("covers")


#: Two runs are linked where one centre has passages with both, or where one document is the centre of the other's.
_LINKED = "arrays_overlap(held, theirs) or array_contains(held, rep) or array_contains(theirs, doc)"


def _apart(rows: DataFrame) -> DataFrame:
    """``rows(key, doc, place, held)`` joined with the first place of the smallest document of their key (rep, other, theirs), where no passage links the two there."""
    first = rows.groupBy("key").agg(F.min(F.struct("doc", F.size("held").alias("n"), "place", "held")).alias("o"), F.max("doc").alias("most"), F.count("*").alias("n")).where("o.doc < most")
    first = durable(first.select("key", F.col("o.doc").alias("rep"), F.col("o.place").alias("other"), F.col("o.held").alias("theirs"), "n"), "firsts")
    total = first.agg(F.sum("n")).first()[0] or 0
    return with_hot(rows, first, "key", total, BLOCK).where(f"doc <> rep and not ({_LINKED})").drop("n")


def _still_apart(apart: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Those rows of ``apart`` that the passages of ``found`` do not link either."""
    swapped = ["key", "rep as doc", "other as place", "theirs as held", "doc as rep", "place as other", "held as theirs"]
    for _ in range(2):
        apart = _held(apart, found, length).selectExpr(*swapped)
    return apart.where(f"not ({_LINKED})")


def _pairs_of(apart: DataFrame) -> DataFrame:
    """(doc, rep, anchors)."""
    return apart.groupBy("doc", "rep").agg(F.collect_set(F.struct("place", "other", F.lit(True).alias("beside"))).alias("anchors"))


def _rest(texts: DataFrame, found: DataFrame, k: int, passage: int, threshold: float, agree: int) -> list[DataFrame]:
    """Passages of documents that share a run of words with another one where none of ``found`` links them."""
    spark = texts.sparkSession
    schema, length = "key long, doc long, place long", passage - SPARE
    every = texts.mapInArrow(_runs(passage, SPARE, None), schema)
    shared = every.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("key")
    shared = durable(shared, "runs")
    n = shared.count()
    if not n:
        return []
    wanted = spark.sparkContext.broadcast(bloom.build(shared, n))
    rows = durable(_held(texts.mapInArrow(_runs(passage, SPARE, wanted), schema), found, length), "around")
    forget(shared)
    told = durable(_apart(rows), "apart")
    forget(rows)
    pairs = durable(_pairs_of(told), "pairs")
    out = [_verified(texts, pairs, k, passage, threshold, agree)]
    forget(pairs)
    # What is still apart shares a run that lies in no common passage with the first of that run.
    apart = durable(_still_apart(told, out[0], length).select("key", "doc", "rep"), "apart")
    forget(told)
    n = apart.select("key").distinct().count()
    if not n:
        return out
    near = spark.sparkContext.broadcast(bloom.build(apart.select("key").distinct(), n))
    docs = durable(apart.select("doc").union(apart.select("rep")).distinct(), "docs")
    again = bloom.rows_of(texts, docs).mapInArrow(_runs(passage, 0, None, near), schema)
    again = durable(_held(_held(again, found, passage), out[0], passage), "around")
    pairs = durable(_pairs_of(_apart(again)), "pairs")
    out.append(_verified(texts, pairs, k, passage, threshold, agree))
    forget(again), forget(pairs), forget(apart)
    return out


def repeated_passages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, passage: int = PASSAGE, hashes: int = HASHES, agree: int = AGREE, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per passage that a document shares with an earlier one.

    Columns: doc_id, start_word, end_word (exclusive), other_id, other_start,
    other_end, n_words, similarity (of the sets of ``k``-word shingles of both
    sides, ``threshold`` at least).  Passages have ``passage`` words or more.
    ``other_id`` is the smallest document of those with the same window
    minimum if that one holds the passage, else the smallest of those that
    share a run of words with it, so a passage of any number of documents
    gives a row for each but one, not for each pair.  Each document that
    repeats ``passage`` words exactly has a row or is the other one of a row;
    looser passages are found as far as their minima agree with the centre's.
    Repeats inside one document alone give no row.

    Null and shorter texts have no passages; rows with a null id are not
    compared; rows that repeat an id are compared as one document.  Texts of
    any length are taken whole and further columns are not read.  No rows give
    no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark, 256)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    minima = texts.mapInArrow(_minima(hashes, k, passage), "low long, doc long")
    shared = minima.groupBy("low").agg(F.min("doc").alias("rep"), F.max("doc").alias("most"), F.count("*").alias("n")).where("rep < most")
    shared = durable(shared.select("low", "rep", "n"), "minima")
    count, total = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = spark.sparkContext.broadcast(bloom.build(shared.select("low"), count))
    windows = texts.mapInArrow(_shared_windows(hashes, k, passage, bits), "low long, doc long, place long, before long, after long")
    windows = durable(with_hot(windows, shared, "low", total, BLOCK), "windows")
    forget(shared)
    # The first window of the smallest document stands for all with this minimum.
    centre = windows.where("doc = rep").groupBy("low").agg(F.min(F.struct("place", "before", "after")).alias("o"), F.max("n").alias("n"))
    beside = ((F.col("before") == F.col("o.before")) & (F.col("before") != 0)) | ((F.col("after") == F.col("o.after")) & (F.col("after") != 0))
    stars = with_hot(windows.where("doc <> rep").drop("n"), centre, "low", total, BLOCK).select("doc", "rep", "place", F.col("o.place").alias("other"), beside.alias("beside"))
    pairs = stars.groupBy("doc", "rep").agg(F.collect_set(F.struct(*_ANCHOR)).alias("anchors"), F.bool_or("beside").alias("beside"), F.expr(f"bit_or(shiftleft(1, cast(other & {(1 << _OF) - 1} as int)))").alias("of"))
    pairs = durable(pairs.where(F.col("beside") | (F.bit_count("of") >= agree)).select("doc", "rep", "anchors"), "pairs")
    found = _verified(texts, pairs, k, passage, threshold, agree)
    forget(pairs), forget(windows)
    every = found
    for more in _rest(texts, found, k, passage, threshold, agree):
        every = every.union(more)
    # A pair of documents may meet more than once; of passages with the same start the longest stays.
    start = ["doc_id", "start_word", "other_id", "other_start"]
    best = every.groupBy(*start).agg(F.max(F.struct("end_word", "other_end", "n_words", "similarity")).alias("p")).select(*start, "p.*")
    return best.select(*[x.split()[0] for x in PASSAGES.split(", ")])
