"""URL allow and block lists as a trie over reversed host labels and path segments."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast; a list whose pickled trie is larger has to be split by the caller.
MAX_TRIE_BYTES = 256 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def _segments(path: str) -> list[str]:
    """Pieces that end with their slash; the last piece has none."""
    parts = path.split("/")
    return [x + "/" for x in parts[:-1]] + [parts[-1]]


class UrlTrie:
    """Nodes are dicts; host labels run from the last to the first, then path segments follow.

    A rule whose path does not end with a slash keeps its last piece as a
    prefix to test at its node.  A deeper node is a longer rule, so the last
    rule met is the longest; a path beats none at the same host.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]] = ()) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            self.add(verdict, host, path)

    def add(self, verdict: str, host: str, path: str) -> None:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        host = host.translate(_LOWER)
        node = self.root
        for label in reversed(host.split(".")):
            node = node.setdefault(("h", label), {})
        *whole, last = _segments(path)
        for piece in whole:
            node = node.setdefault(("p", piece), {})
        ends = node.setdefault("ends", {})
        held = ends.get(last)
        if held is None or verdict == "block":  # of equal rules, block wins
            ends[last] = (verdict, host + path)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        best, pieces = None, _segments(path)
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            at = node
            for piece in pieces:
                ends = at.get("ends")
                if ends:
                    fit = [x for x in ends if piece.startswith(x)]
                    if fit:
                        best = ends[max(fit, key=len)]
                at = at.get(("p", piece))
                if at is None:
                    break
        return best


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict.

    ``rules`` are (verdict, host, path).  A rule fits its host and all
    subdomains if the path starts with the rule's; the longest host wins, then
    the longest path, then block over allow.  Without a rule the verdict is
    ``default``.  A null url or one without ``://`` has an empty host and path.
    The trie is broadcast only below ``MAX_TRIE_BYTES``.  Very long urls are
    taken whole, repeated rows are judged alike, and further columns are not
    read.  The id column keeps its name and type and may be null.
    """
    trie = UrlTrie(rules)
    size = len(pickle.dumps(trie))
    if size > MAX_TRIE_BYTES:
        raise ValueError(f"{size} bytes of rules are too many to broadcast")
    shared = pages.sparkSession.sparkContext.broadcast(trie)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.longest
        for batch in batches:
            parts = [split_url(x) for x in batch.column(1).to_pylist()]
            found = [find(*x) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in parts], pa.string()), pa.array([x[1] for x in parts], pa.string()), pa.array([x and x[1] for x in found], pa.string()), pa.array([x[0] if x else default for x in found], pa.string())],
                [id_col, "host", "path", "rule", "verdict"],
            )

    kind = pages.select(id_col).schema[0].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col).alias("__url")).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
