"""Order-preserving packing of documents into fixed windows.

Each partition is one stream of token ids in its own order.  Dynamic
programming chooses the cuts: places after a document (no penalty), after a
sentence (a small penalty) and, only where a window would otherwise hold no
place to cut, after any token (a large penalty).  With ``f(i)`` the least cost
of a stream cut at place ``i`` and ``L`` the window,

    f(i) = penalty(i) + min over j in [i - L, i) of f(j) + L - (i - j)

whose minimum of ``f(j) + j`` over a sliding range is kept by a monotone
queue.  A window of a power of two is not padded, so these few lengths are
further transitions without the padding term.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm.durable import bound_batches

WINDOW, END_ID = 4096, 2
#: Costs in padding tokens: a cut inside a document after a sentence, and one inside a sentence.
SENTENCE_COST, TOKEN_COST = 8, 24
#: Distance of places inside a run without boundaries.
STEP = 16
#: What a window costs besides, so that short windows of a power of two don't multiply.
SEQUENCE_COST = 32
#: Ids per planning block; memory is bounded by this and one document.
BLOCK_IDS = 1 << 19
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _splits(body: bytes) -> bool:
    """Whether the tokenizer splits ``body`` from punctuation after it: a run of what is no letter or digit stays whole."""
    if body[-1] < 128:
        return body[-1:].isalnum()
    # The tokenizer composes and lower-cases first, after which a letter may end in a mark.
    last = unicodedata.normalize("NFC", body[-4:].decode("utf-8", "ignore")[-1]).lower()[-1]
    return unicodedata.category(last)[0] in "LN"


def _short_cuts(tokenizer: object) -> bool:
    """Whether the tokenizer composes, lower-cases, splits words from other signs and drops white space."""
    import json

    told = json.loads(tokenizer.to_str())
    normal = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
    split = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = split[0].get("pattern", {}).get("Regex", "") if split else ""
    return normal == ["NFC", "Replace", "Lowercase"] and r"[^\s\p{L}\p{N}]+" in pattern and (told.get("model") or {}).get("end_of_word_suffix") == "</w>"


class CachedEncoder:
    """Ids of a text as little-endian uint32 bytes, equal to one call of the tokenizer.

    The tokenizer of words drops white space and never joins across it, so a
    text's ids are those of its pieces between ASCII white space, and those of
    a piece without ``<`` are those of its body and of the punctuation after
    it where the body ends in a letter or digit.  ``_short_cuts`` tells whether
    a tokenizer is of this kind; with others each text is encoded whole.  A body of letters up to U+00FF is one word, for which the model alone
    is asked.  Pieces repeat, so their ids are kept in a bounded table.
    """

    def __init__(self, path: str, capacity: int = 900_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity = capacity
        self.held: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.as_bytes = [x.tobytes() for x in np.arange(size, dtype="<u4")]
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {i: bytewise.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        closing = re.compile(r".*[.!?]['\")\]]*</w>\Z", re.DOTALL)
        self.piecewise = _short_cuts(self.tokenizer)
        self.closes = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = bool(closing.match(token))

    def _encode(self, piece: bytes) -> bytes:
        word, table = piece.decode("utf-8"), self.as_bytes
        if piece.isalpha():
            return b"".join([table[t.id] for t in self.tokenizer.model.tokenize(word)])
        if _LETTERS.fullmatch(word):
            return b"".join([table[t.id] for t in self.tokenizer.model.tokenize(word.lower().translate(self.spelled))])
        return b"".join([table[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def _missing(self, piece: bytes) -> bytes:
        held = self.held
        if len(held) >= self.capacity:
            held.clear()
        body = piece.rstrip(_PUNCT)
        if body and len(body) < len(piece) and b"<" not in piece and _splits(body):
            tail = piece[len(body) :]
            found = (held.get(body) or self._missing(body)) + (held.get(tail) or self._missing(tail))
        else:
            found = self._encode(piece)
        held[piece] = found
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.piecewise:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        get, missing = self.held.get, self._missing
        data = text.encode("utf-8", "replace")
        if b"<" in data:
            # A special token counts only as it is written.
            pieces = [x if b"<" in x else x.lower() for x in data.split()]
        else:
            pieces = data.lower().split()
        return b"".join([get(x) or missing(x) for x in pieces])


def cut_places(tokens: int, sentence_ends: np.ndarray, document_ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places to cut and the cost of each.

    Cuts lie at the ends of documents and sentences; a sentence longer than a
    quarter of the window may also be cut inside, every ``STEP`` tokens.
    """
    place = np.union1d(sentence_ends, document_ends)
    cost = np.where(np.isin(place, document_ends, assume_unique=True), 0, SENTENCE_COST)
    gaps = np.diff(np.concatenate(([0], place)))
    extra = [np.arange(p - g + STEP, p, STEP) for p, g in zip(place[gaps > window // 4], gaps[gaps > window // 4], strict=True)]
    if extra:
        more = np.concatenate(extra)
        place, cost = np.concatenate((place, more)), np.concatenate((cost, np.full(len(more), TOKEN_COST)))
        order = np.argsort(place, kind="stable")
        place, cost = place[order], cost[order]
    return place, cost


def plan_cuts(place: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> tuple[list[int], int]:
    """The cuts of least cost from 0 to the last place, and that cost."""
    spots = np.concatenate(([0], place))
    at, fee = spots.tolist(), [0, *(cost + SEQUENCE_COST).tolist()]
    n = len(at)
    exact: dict[int, list[int]] = {}
    for power in (1 << k for k in range(window.bit_length()) if 1 << k <= window):
        ends = np.arange(1, n)
        source = np.searchsorted(spots, spots[ends] - power)
        hit = spots[source] == spots[ends] - power
        for i, k in zip(ends[hit].tolist(), source[hit].tolist(), strict=True):
            exact.setdefault(i, []).append(k)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    none: list[int] = []
    for i in range(1, n):
        here = at[i]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        low, source = queue[0]
        low += window - here
        for k in exact.get(i, none):
            if best[k] < low:
                low, source = best[k], k
        low += fee[i]
        best[i], back[i] = low, source
        key = low + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    cuts, i = [], n - 1
    while i:
        cuts.append(at[i])
        i = back[i]
    return cuts[::-1], best[-1]


def _pieces(docs: list[tuple], cuts: list[int], stop: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset) up to the cut ``stop``."""
    d, into, at = 0, 0, 0
    for sequence, cut in enumerate(cuts):
        if cut > stop:
            return
        offset = 0
        while at < cut:
            size = docs[d][2]
            take = min(size - into, cut - at)
            yield d, into, take, sequence, offset
            into, at, offset = into + take, at + take, offset + take
            if into == size:
                d, into = d + 1, 0


def _packer(encoder: Callable[[], CachedEncoder], window: int, block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        end = np.array([END_ID], dtype="<u4").tobytes()
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        #: (id, ids, length here, start in the document, length of the document)
        held: list[tuple] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, sequence
            stream = np.frombuffer(b"".join(x[1] for x in held), dtype="<u4")
            ends = np.cumsum([x[2] for x in held])
            closing = coder.closes[np.minimum(stream, len(coder.closes) - 1)]
            sentence = np.flatnonzero(closing) + 1
            cuts, _ = plan_cuts(*cut_places(size, sentence[sentence < size], ends, window), window)
            # The windows before the last few are settled; the rest opens the next block.
            stop = size if last or len(cuts) < 8 else cuts[-5]
            if not last and stop == size:
                return
            rows, used = [], 0
            for d, into, take, k, offset in _pieces(held, cuts, stop):
                i, ids, _, start, whole = held[d]
                rows.append((i, start + into, take, whole, sequence + k, offset, ids[4 * into : 4 * (into + take)]))
                used = max(used, k)
            sequence += used + 1
            for at in range(0, len(rows), 2048):
                part = list(zip(*rows[at : at + 2048], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *(pa.array(x, pa.int64()) for x in part[1:6]), pa.array(part[6], pa.binary())], [x.split()[0] for x in PIECES.split(", ")])
            rest, at = [], 0
            for i, ids, n, start, whole in held:
                skip = min(max(stop - at, 0), n)
                if skip < n:
                    rest.append((i, ids[4 * skip :], n - skip, start + skip, whole))
                at += n
            held, size = rest, size - stop

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.ids(text) + end
                held.append((i, ids, len(ids) // 4, 0, len(ids) // 4))
                size += len(ids) // 4
                if size >= block:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return pack


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK_IDS
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    A document's ids are those of its text without special tokens, then id 2;
    a null or empty text is that id alone.  Each id lies in one piece.  The
    pieces of a sequence lie gapless from offset 0 and hold at most ``window``
    ids (little-endian uint32 in ``ids``).  A sequence belongs to one
    partition of the input, whose number forms its id, so a task that is run
    again gives the same rows.  Rows with a null or repeated id are packed
    like others.  Texts of any length are taken whole; further columns are not
    read.  No rows give no rows.
    """
    bound_batches(docs.sparkSession)

    def encoder() -> CachedEncoder:
        return CachedEncoder(tokenizer_path)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_packer(encoder, window, block), PIECES)
