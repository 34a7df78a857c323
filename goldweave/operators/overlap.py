"""Best partners between one block of left rows and one block of right rows, by an inverted index over the right ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class _Tokens:
    """One list column of both blocks: the left rows' token codes, and the right rows that hold each code."""

    def __init__(self, left: pa.ChunkedArray, right: pa.ChunkedArray) -> None:
        flat = pa.chunked_array([*_flat(left), *_flat(right)], pa.string()).combine_chunks()
        codes = pc.dictionary_encode(flat).combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat.dictionary_encode()
        self.l_size, self.r_size = _sizes(left), _sizes(right)
        n = int(self.l_size.sum())
        ids, held = codes.indices.to_numpy(zero_copy_only=False), len(codes.dictionary)
        self._codes, self._at = ids[:n], np.concatenate(([0], np.cumsum(self.l_size))).tolist()
        rows = np.repeat(np.arange(len(right)), self.r_size)
        self._rows = rows[np.argsort(ids[n:], kind="stable")]
        counts = np.bincount(ids[n:], minlength=held)
        self._ends = np.concatenate(([0], np.cumsum(counts))).tolist()
        self.type = np.uint8 if self.l_size.max(initial=0) < 256 else np.uint32
        # Tokens of many rows are added as whole vectors; they are few, as a row has few tokens.
        self._dense = {}
        asked = np.bincount(self._codes, minlength=held) > 0
        for c in np.flatnonzero(asked & (counts > max(64, len(right) // 64))).tolist():
            v = np.zeros(len(right), self.type)
            v[self._rows[self._ends[c]:self._ends[c + 1]]] = 1
            self._dense[c] = v

        self._counts, self._names = counts, codes.dictionary

    def among(self, tokens: pa.ChunkedArray) -> set[int]:
        """The codes of the given lists' tokens."""
        some = pc.unique(pa.chunked_array(_flat(tokens), pa.string()))
        return set(pc.index_in(some, value_set=self._names).drop_null().to_pylist())

    def of(self, i: int) -> list[int]:
        """The codes of left row ``i``."""
        return self._codes[self._at[i]:self._at[i + 1]].tolist()

    def add(self, codes: list[int], to: np.ndarray) -> None:
        """Count in ``to`` the tokens of ``codes`` that each right row has."""
        for c in codes:
            v = self._dense.get(c)
            if v is None:
                to[self._rows[self._ends[c]:self._ends[c + 1]]] += 1
            else:
                to += v


def _flat(column: pa.ChunkedArray) -> list[pa.Array]:
    return [pc.cast(c.flatten(), pa.string()) for c in column.chunks]


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)


def _best(scores: np.ndarray, k: int | None) -> np.ndarray:
    """Places of the ``k`` largest, the first ones among equals; of all without ``k``."""
    if k is None or len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    taken = scores > least
    taken[np.flatnonzero(scores == least)[: k - int(taken.sum())]] = True
    return np.flatnonzero(taken)


def _overlap(both: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    return both / np.maximum(a + b - both, 1)


def _least_shared(a: int, b: np.ndarray, rough: float) -> np.ndarray:
    """The fewest common tokens, one at least, by which rows of ``a`` and ``b`` tokens overlap by ``rough`` or more."""
    least = np.maximum(np.floor(rough * (a + b) / (1 + rough)).astype(np.int64) - 1, 1)
    while len(short := np.flatnonzero((_overlap(least, a, b) < rough) & (least < np.minimum(a, b)))):
        least[short] += 1
    return least


def _places(near: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a long vector of bools with few true ones: looks at eight at a time first."""
    whole = len(near) & ~7
    some = np.flatnonzero(near[:whole].view(np.uint64))
    if len(some) > len(near) // 64:
        return np.flatnonzero(near)
    at = np.flatnonzero(near[:whole].reshape(-1, 8)[some])
    return np.concatenate((some[at >> 3] * 8 + (at & 7), np.flatnonzero(near[whole:]) + whole))


def _titles(left: pa.Table, right: pa.Table, rough: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(left row, places of right rows, scores) where rows have one column.

    Its tokens are keys but for those that a right row names as ``common``.
    Left rows go in the order of their common tokens, so that those are counted
    once for all rows that have the same ones, and rows of the same tokens once
    altogether.  A count alone tells, by the sizes of both rows, whether a pair
    scores enough; and it has a key where it is more than that of the common ones.
    """
    t = _Tokens(left["p0"], right["p0"])
    common = t.among(right["common"])
    sizes, of = np.unique(t.r_size, return_inverse=True)
    base, most = np.zeros(right.num_rows, t.type), int(np.iinfo(t.type).max)
    shared = np.zeros_like(base)
    needs: dict[int, np.ndarray] = {}
    rows = []
    for i in range(left.num_rows):
        codes = sorted(t.of(i))
        rows.append(([c for c in codes if c in common], [c for c in codes if c not in common], i))
    counted, last = [], None
    for rest, keys, i in sorted(rows):
        if last != (rest, keys):
            last, a = (rest, keys), len(rest) + len(keys)
            if a not in needs:
                needs[a] = np.minimum(_least_shared(a, sizes, rough), most).astype(t.type)[of]
            if counted != rest:
                base[:] = 0
                t.add(rest, base)
                counted = rest
            np.copyto(shared, base)
            t.add(keys, shared)
            at = _places(shared >= needs[a])
            if rest:
                at = at[shared[at] > base[at]]
            score = _overlap(shared[at].astype(np.int64), a, t.r_size[at])
        if len(at):
            yield i, at, score


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as ``n`` says, one after another."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _sorted_within(group: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """The values, which are less than ``most``, in order within each group; groups follow one another."""
    return np.sort(group * most + values) - group * most


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of numbers; the upper bits are the better ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


#: Words of bits of a set.
_WORDS = 4


class _Sets:
    """The distinct token sets of some rows, as ranks that rise within a set, and the rows that have each."""

    def __init__(self, sizes: np.ndarray, ranks: np.ndarray, held: int) -> None:
        ranks = _sorted_within(np.repeat(np.arange(len(sizes)), sizes), ranks, held).astype(np.int32)
        at = np.concatenate(([0], np.cumsum(sizes)))
        of = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at * 4), pa.py_buffer(ranks)])
        of = of.dictionary_encode().indices.to_numpy().astype(np.int64)
        # Numbers are given in the order in which sets appear.
        first = np.flatnonzero(of > np.concatenate(([-1], np.maximum.accumulate(of)))[: len(of)])
        self.rows, self.copies = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(first))
        self.starts = np.cumsum(self.copies) - self.copies
        self.sizes = sizes[first]
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.ranks = ranks[_spread(at[first], self.sizes)]
        #: One bit for each token, in words of 64.
        h = _mixed(self.ranks.astype(np.uint64))
        at = np.repeat(np.arange(len(first)), self.sizes) * _WORDS + (h >> np.uint64(56)).astype(np.int64) % _WORDS
        some = np.zeros(len(first) * _WORDS, np.uint64)
        np.bitwise_or.at(some, at, np.uint64(1) << (h >> np.uint64(48) & np.uint64(63)))
        self.some = some.reshape(-1, _WORDS).T.copy()

    def matrix(self, some: np.ndarray, size: int) -> np.ndarray:
        """The ranks of sets of one size, a row for each place in a set."""
        return self.ranks.take(self.begin[some] + np.arange(size)[:, None])


def _firsts(group: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Those of the places ``order``, by which groups follow one another, that are among the first ``k`` of their group."""
    g = group[order]
    new = np.concatenate(([True], g[1:] != g[:-1]))[: len(g)]
    return order[np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) < k]


#: Pairs of sets that are held at once.
_HELD = 1 << 20
#: Sets of no more tokens meet by two tokens, so that the pairs of tokens stay few.
_SHORT = 32
#: Scores above the least one at which rows that have enough partners are done.
_LEVELS = (0.8, 0.5, 0.36, 0.26)
#: Bits of a signature for the largest size of a set with which it counts.
_SIZE = 8


class _Titles:
    """The token sets of two blocks whose rows have one column.

    Tokens are keys but for those that a right row names as ``common``, and are
    ranked, the rarest first and the common ones last.  Equal rows are compared
    once.  Sets of ``a`` and ``b`` tokens score enough if they share ``c``,
    known by both sizes; then the first ``n`` of what they share lie within the
    first ``a - c + n`` of the one and ``b - c + n`` of the other.  So sets
    meet by the two first tokens that they share (by the first where one is
    enough, or a set is long), of which the first is a key, and those that meet
    are compared.
    """

    def __init__(self, left: pa.Table, right: pa.Table) -> None:
        flat = pa.chunked_array([*_flat(left["p0"]), *_flat(right["p0"])], pa.string()).combine_chunks()
        codes = pc.dictionary_encode(flat).combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat.dictionary_encode()
        l_size, r_size, held = _sizes(left["p0"]), _sizes(right["p0"]), len(codes.dictionary)
        ids, cut = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), int(l_size.sum())
        named = pc.unique(pa.chunked_array(_flat(right["common"]), pa.string()))
        common = np.zeros(held, bool)
        common[pc.index_in(named, value_set=codes.dictionary).drop_null().to_numpy(zero_copy_only=False)] = True
        rank = np.empty(held, np.int64)
        rank[np.lexsort((np.bincount(ids[cut:], minlength=held), common))] = np.arange(held)
        self.keys = held - int(common.sum())
        self.l, self.r = _Sets(l_size, rank[ids[:cut]], held), _Sets(r_size, rank[ids[cut:]], held)
        self.l_sizes, self.r_sizes = (np.unique(s.sizes[s.sizes > 0]) for s in (self.l, self.r))
        self.marks = np.zeros(held, np.uint64)
        self.bits = max(len(self.r.sizes) - 1, 1).bit_length()

    def _limits(self, rough: float) -> tuple[dict, dict]:
        """By the size of a left set, and of a right one: (places, largest size of the other side) of its single tokens, and the same for the second of two."""
        l_most, r_most = {}, {}
        for a in self.l_sizes.tolist():
            least = _least_shared(a, self.r_sizes, rough)
            fit = (least <= np.minimum(a, self.r_sizes)) & (_overlap(least, a, self.r_sizes) >= rough)
            for b, c in zip(self.r_sizes[fit].tolist(), least[fit].tolist(), strict=True):
                n = 2 if c > 1 and max(a, b) <= _SHORT else 1
                # A place counts with each size up to the largest one that leaves it within the limit.
                for most, own, other in ((l_most, a, b), (r_most, b, a)):
                    for place in range(n - 1, own - c + n):
                        at = most.setdefault((n, own), {})
                        at[place] = max(at.get(place, 0), other)
        return l_most, r_most

    def _signatures(self, sets: _Sets, some: np.ndarray, most: dict) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(hashes, sets, largest size on the other side) of the tokens, or pairs of tokens, by which the sets ``some`` meet others."""
        sizes = sets.sizes[some]
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = some[sizes == size]
            ranks = sets.matrix(own, size).astype(np.uint64)
            key = ranks < self.keys
            for n in (1, 2):
                for place, other in most.get((n, size), {}).items():
                    for first in range(place) if n == 2 else [place]:
                        h = _mixed(ranks[first] << np.uint64(32) | ranks[place])
                        good = key[first]
                        yield (h, own, other) if good.all() else (h[good], own[good], other)

    def pairs(self, live: np.ndarray, rough: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left sets, right sets, scores) of the pairs of the left sets ``live`` that have a key and score ``rough`` or more; those of one left set together."""
        l, r, low = self.l, self.r, _SIZE + self.bits  # noqa: E741
        l_most, r_most = self._limits(rough)
        full = (1 << _SIZE) - 1
        cut = lambda h: (h >> np.uint64(low + 2) << np.uint64(low)).astype(np.int64)
        mine = [(cut(h), own, np.full(len(own), other)) for h, own, other in self._signatures(l, live, l_most)]
        if not mine:
            return
        h, own, other = map(np.concatenate, zip(*mine, strict=True))
        by = np.argsort(h)
        h, own, other = h[by], own[by], other[by]
        # Of the right signatures only those stay that the left ones may hold: hash, largest size of a left set, number of the set.
        wide = min(max(len(h).bit_length() + 3, 10), 24)
        asked = np.zeros(1 << wide, bool)
        asked[h >> (62 - wide)] = True
        theirs = []
        for k, sets, size in self._signatures(r, np.flatnonzero(r.sizes), r_most):
            may = asked[(k >> np.uint64(64 - wide)).astype(np.int64)]
            theirs.append(cut(k[may]) | (min(size, full) << self.bits) | sets[may])
        theirs = np.sort(np.concatenate(theirs)) if theirs else np.empty(0, np.int64)
        # Right sets that count with this size of the left one have it or more.
        start = np.searchsorted(theirs, h | np.minimum(l.sizes[own], full) << self.bits)
        n = np.searchsorted(theirs, h + (1 << low)) - start
        by = np.argsort(own[n > 0], kind="stable")
        own, other, start, n = (v[n > 0][by] for v in (own, other, start, n))
        upto = np.cumsum(n)
        edge = np.flatnonzero(np.diff(own, append=-1)) + 1
        at = 0
        while at < len(own):
            goal = (upto[at - 1] if at else 0) + _HELD
            k = int(np.searchsorted(upto[edge - 1], goal, "right"))
            stop = int(edge[max(k - 1, int(np.searchsorted(edge, at, "right")))])
            part = slice(at, stop)
            y = theirs[_spread(start[part], n[part])] & ((1 << self.bits) - 1)
            near = r.sizes[y] <= np.repeat(other[part], n[part])
            met = np.sort((np.repeat(own[part], n[part])[near] << self.bits) | y[near])
            met = met[np.concatenate(([True], met[1:] != met[:-1]))[: len(met)]]
            yield self._compared(met >> self.bits, met & ((1 << self.bits) - 1), rough)
            at = stop

    def _compared(self, x: np.ndarray, y: np.ndarray, rough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs, in order of their left sets, that score enough, and their scores.

        A token whose bit the other set has not is not shared, which rules most
        pairs out.  Of 64 left sets at once each token marks by bits those that
        have it.
        """
        l, r = self.l, self.r  # noqa: E741
        a, b = l.sizes[x], r.sizes[y]
        l_rest, r_rest = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for m, n in zip(l.some, r.some, strict=True):
            m, n = m[x], n[y]
            both = m & n
            l_rest += np.bitwise_count(m ^ both)
            r_rest += np.bitwise_count(n ^ both)
        good = np.flatnonzero(_overlap(np.minimum(a - l_rest, b - r_rest), a, b) >= rough)
        x, y = x[good], y[good]
        own, of = np.unique(x, return_inverse=True)
        both = np.empty(len(x), np.int64)
        cut = np.searchsorted(of, np.arange(0, len(own) + 64, 64))
        for k in range(len(cut) - 1):
            some, part = own[64 * k : 64 * k + 64], slice(cut[k], cut[k + 1])
            tokens = l.ranks[_spread(l.begin[some], l.sizes[some])]
            np.bitwise_or.at(self.marks, tokens, np.repeat(np.uint64(1) << np.arange(len(some), dtype=np.uint64), l.sizes[some]))
            n = r.sizes[y[part]]
            held = self.marks[r.ranks[_spread(r.begin[y[part]], n)]] >> np.repeat((of[part] & 63).astype(np.uint64), n)
            both[part] = np.add.reduceat((held & np.uint64(1)).view(np.int64), np.cumsum(n) - n)
            self.marks[tokens] = 0
        score = _overlap(both, l.sizes[x], r.sizes[y])
        good = np.flatnonzero(score >= rough)
        return x[good], y[good], score[good]

    def rows(self, x: np.ndarray, y: np.ndarray, score: np.ndarray, top_k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows from pairs of sets; the best ``top_k`` of each left row, the first ones among equals."""
        l, r = self.l, self.r  # noqa: E741
        if top_k is not None:
            # More sets, or more copies of one, can't be among the best.
            best = _firsts(x, np.lexsort((r.rows[r.starts[y]], -score, x)), top_k)
            x, y, score = x[best], y[best], score[best]
        n = r.copies[y] if top_k is None else np.minimum(r.copies[y], top_k)
        row = r.rows[_spread(r.starts[y], n)]
        x, score = np.repeat(x, n), np.repeat(score, n)
        if top_k is not None:
            best = _firsts(x, np.lexsort((row, -score, x)), top_k)
            x, row, score = x[best], row[best], score[best]
        n = l.copies[x]
        return l.rows[_spread(l.starts[x], n)], np.repeat(row, n), np.repeat(score, n)


def _met_titles(left: pa.Table, right: pa.Table, rough: float, top_k: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of left rows, places of right rows, scores) where rows have one column, as ``_titles``, but only for the ``top_k`` best of each left row.

    The higher the least score, the fewer places of a set count.  So rows are
    first asked for partners of a high one; those that have ``top_k`` of them
    are done, and the others are asked again for less.
    """
    t = _Titles(left, right)
    live = np.flatnonzero(t.l.sizes)
    for level in [x for x in _LEVELS if x > rough and top_k is not None] + [rough]:
        done = np.zeros(len(t.l.sizes), bool)
        for x, y, score in t.pairs(live, level):
            if level > rough:
                have = np.bincount(x, weights=t.r.copies[y], minlength=len(done)) >= top_k
                x, y, score = (v[have[x]] for v in (x, y, score))
                done |= have
            yield t.rows(x, y, score, top_k)
        live = live[~done[live]]


#: Candidates of a left row from which on a bound from a share of them rules most others out.
_MANY, _SHARE = 2048, 16


def _columns(left: pa.Table, right: pa.Table, weights: list[float], top_k: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(left row, places of right rows, scores) where rows have several columns, and keys of their own.

    Where a row has many candidates, some are scored first; those whose score
    would be less than the ``top_k``-th of these even if they had no tokens
    besides the common ones are left out.
    """
    keys = _Tokens(left["keys"], right["keys"])
    columns = [(w, _Tokens(left[f"p{i}"], right[f"p{i}"])) for i, w in enumerate(weights) if w > 0]
    hit = np.zeros(right.num_rows, keys.type)
    shared = [np.zeros(right.num_rows, t.type) for _, t in columns]

    def scores(i: int, at: np.ndarray) -> np.ndarray:
        total, used = np.zeros(len(at)), np.zeros(len(at))
        for (w, t), s in zip(columns, shared, strict=True):
            a, b = int(t.l_size[i]), t.r_size[at]
            if a:
                total += w * _overlap(s[at].astype(np.int64), a, b)
                used += w
            else:
                used += np.where(b > 0, w, 0.0)
        return np.where(used > 0, total / np.where(used > 0, used, 1.0), 0.0)

    def bounds(i: int, at: np.ndarray) -> np.ndarray:
        most, used = np.zeros(len(at)), 0.0
        for (w, t), s in zip(columns, shared, strict=True):
            if a := int(t.l_size[i]):
                most += (w / a * np.arange(a + 1))[s[at]]
                used += w
        return most / used if used else most

    for i in range(left.num_rows):
        hit[:] = 0
        keys.add(keys.of(i), hit)
        at = _places(hit > 0)
        if not len(at):
            continue
        for (_, t), s in zip(columns, shared, strict=True):
            s[:] = 0
            t.add(t.of(i), s)
        if top_k is not None and len(at) > _MANY and len(some := at[::_SHARE]) >= top_k:
            least = np.partition(scores(i, some), len(some) - top_k)[len(some) - top_k]
            at = at[bounds(i, at) >= least - 1e-9]
        yield i, at, scores(i, at)


#: Right rows from which on sets of titles meet by tokens, as counting grows with the rows.
MANY_TITLES = 100_000


def _found(left: pa.Table, right: pa.Table, weights: list[float], rough: float, top_k: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of left rows, places of right rows, scores) of the ``top_k`` best."""
    if "common" in right.column_names and rough > 0 and right.num_rows >= MANY_TITLES:
        yield from _met_titles(left, right, rough, top_k)
        return
    scored = _titles(left, right, rough) if "common" in right.column_names else _columns(left, right, weights, top_k)
    for i, at, score in scored:
        good = np.flatnonzero(score >= rough)
        good = good[_best(score[good], top_k)]
        if len(good):
            yield np.full(len(good), i), at[good], score[good]


def best_of_block(left: pa.Table, right: pa.Table, *, weights: list[float], rough: float, top_k: int | None, schema: pa.Schema) -> pa.Table:
    """(l_id, r_id, rough_score): the ``top_k`` best pairs of each left row among the right rows that share a key.

    Both tables have id and one list of distinct tokens ``p0``, ``p1``, ...
    for each weight.  With several weights they have keys as well; with one the
    right table has ``common``, the tokens of a row that are no keys.  The
    score is that of ``blocking.rough_score``, in the same order of operations.
    """
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    right = right.sort_by("id")
    places, partners, scores = [], [], []
    for i, at, score in _found(left, right, weights, rough, top_k):
        places.append(i)
        partners.append(at)
        scores.append(score)
    if not sum(map(len, places)):
        return schema.empty_table()
    found = [left["id"].take(pa.array(np.concatenate(places))), right["id"].take(pa.array(np.concatenate(partners))), pa.array(np.concatenate(scores))]
    return pa.table(found, names=schema.names).cast(schema)


def all_of_blocks(batches: Iterator[pa.RecordBatch], *, rough: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(l_id, r_id, rough_score): all pairs of the blocks ``__l`` and ``__r``, whose rows follow one another, the right ones first.

    A task holds two blocks and some of their pairs.  Rows have one column, and ``__left`` tells their side.
    """
    block, held = None, []
    for b in batches:
        at = b["__l"].to_numpy().astype(np.int64) << 32 | b["__r"].to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start and at[start] != block:
                yield from _all_pairs(held, rough, schema)
                block, held = at[start], []
            held.append(b.slice(start, stop - start))
    yield from _all_pairs(held, rough, schema)


def _all_pairs(held: list[pa.RecordBatch], rough: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if not sum(b.num_rows for b in held):
        return
    both = pa.Table.from_batches(held)
    left, right = both.filter(both["__left"]), both.filter(pc.invert(both["__left"]))
    if not left.num_rows or not right.num_rows:
        return
    l_ids, r_ids = (x["id"].combine_chunks() for x in (left, right))
    found, n = [], 0

    def batch() -> pa.RecordBatch:
        i, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([l_ids.take(pa.array(i)), r_ids.take(pa.array(at)), pa.array(score)], schema.names).cast(schema)

    for i, at, score in _titles(left, right, rough):
        good = np.flatnonzero(score >= rough)
        found.append((np.full(len(good), i), at[good], score[good]))
        n += len(good)
        if n >= _HELD:
            yield batch()
            found, n = [], 0
    if n:
        yield batch()
