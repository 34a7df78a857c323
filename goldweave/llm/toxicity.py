"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words is trained by numpy from
documents confirmed as toxic and from unlabelled documents.  With the class
prior p, the risk is p * R_p(+) + max(0, R_u(-) - p * R_p(-)): what positives
cost as negatives is taken out of the unlabelled risk, which is kept from
falling below zero.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.durable import bound_batches, durable

#: Bounds of the training sample, and the least number of training positives with a word.
MAX_POSITIVE, MAX_UNLABELLED, LEAST_DOCS = 4000, 12000, 3
#: Least contrast, in standard errors, of a word between the two samples.
LEAST_CONTRAST = 3.5
#: Least ratio of its shares in them.
LEAST_RATIO = 2.5
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_set(text: str | None) -> set[bytes]:
    """Distinct words of ASCII letters and other characters above U+007F, lower-cased for A-Z."""
    return set() if not text else set(text.encode("utf-8", "replace").translate(_SPLIT).split())


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0."""
    return F.crc32(doc_id.cast("string")) % folds == 0


@dataclass
class Model:
    words: list[bytes]
    weights: np.ndarray
    bias: float
    prior: float

    def scorer(self):
        table = dict(zip(self.words, self.weights.tolist(), strict=True))
        names = frozenset(table)

        def score(text: str | None) -> float:
            z = self.bias + sum(table[w] for w in names & word_set(text))
            return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))

        return score


class Presence:
    """Which of ``d`` words each of some documents has, as index pairs, so that memory follows the hits."""

    def __init__(self, docs: list[list[int]], d: int) -> None:
        self.n, self.d = len(docs), d
        self.row = np.repeat(np.arange(self.n), [len(x) for x in docs])
        self.col = np.array([j for x in docs for j in x], dtype=np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) + w[-1]

    def gradient(self, r: np.ndarray) -> np.ndarray:
        """Mean over documents of ``r`` times their words, and of ``r`` itself for the bias."""
        return np.append(np.bincount(self.col, weights=r[self.row], minlength=self.d), r.sum()) / max(self.n, 1)


def nnpu_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk of positives as such, and the corrected risk of the unlabelled as negatives, with the logistic loss."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def nnpu_fit(positive: Presence, unlabelled: Presence, prior: float, *, epochs: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for the non-negative risk with the logistic loss, by full-batch Adam steps.

    Where the corrected negative risk is below zero the step goes against its
    gradient, as the estimator prescribes.
    """
    d = positive.d
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, epochs + 1):
        zp, zu = positive.times(w), unlabelled.times(w)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        _, negative = nnpu_risk(zp, zu, prior)
        g_minus = unlabelled.gradient(su) - prior * positive.gradient(sp)
        g = prior * positive.gradient(sp - 1) + g_minus if negative >= 0 else -g_minus
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, usable: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """(text, kind) of the confirmed (1) and the unlabelled (0), each the first rows by a hash of their id and text."""
    some = usable.where("toxic").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_positive).select("doc_id", F.lit(1).alias("kind"))
    rest = usable.select("doc_id", F.lit(0).alias("kind")).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(max_unlabelled)
    wanted = F.broadcast(some.union(rest))  # at most max_positive + max_unlabelled ids
    rows = docs.join(wanted, "doc_id").select("doc_id", "text", "kind")
    # Ids that repeat bring more rows than ids, so the bounds hold for rows as well.
    of = lambda kind, n: rows.where(F.col("kind") == kind).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(n)
    return of(1, max_positive).unionByName(of(0, max_unlabelled)).select("text", "kind")


def _vocabulary(words: DataFrame, sizes: dict[int, int]) -> list[bytes]:
    """The words whose share among the confirmed exceeds that among the unlabelled clearly.

    Each is in ``LEAST_DOCS`` of at most ``MAX_POSITIVE`` documents, which
    bounds their number.
    """
    a, b = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    counts = words.groupBy("word").agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u")).where(F.col("p") >= LEAST_DOCS)
    both = (F.col("p") + F.col("u")) / (a + b)
    error = F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / a + 1 / b))
    often = F.col("p") / a >= LEAST_RATIO * F.col("u") / b
    found = counts.where(often).select("word", ((F.col("p") / a - F.col("u") / b) / error).alias("z")).where(F.col("z") > LEAST_CONTRAST)
    return [bytes(r["word"]) for r in found.orderBy(F.desc("z"), "word").collect()]


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5,
    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Train from labels outside the held-out fold.

    The confirmed are at most ``max_positive`` toxic documents; the unlabelled
    are at most ``max_unlabelled`` documents of those in ``labels``, whose label
    is not looked at; both bounds hold for rows, however ids repeat.  The
    prior is the share of toxic ones among all labels that may be used.  Their
    words are counted by Spark, and only the vocabulary and the places of its
    words in the sample come to the driver.  Without confirmed documents the
    model gives every text the prior.
    """
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds))
    # Of labels that repeat an id the toxic one counts.
    usable = usable.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col) == 1).alias("toxic"))
    prior = usable.where("toxic is not null").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = float(min(max(prior or 0.0, 1e-3), 0.5))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = durable(_sample(own, usable, max_positive, max_unlabelled), "sample")
    sizes = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}
    if not sizes.get(1):
        return Model([], np.zeros(0), float(np.log(prior / (1 - prior))), prior)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = list(word_set(text))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([kind] * len(words), pa.int32())], ["word", "kind"])

    words = _vocabulary(sample.mapInArrow(spell, "word binary, kind int"), sizes)
    place = {w: i for i, w in enumerate(words)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = frozenset(place)
        for batch in batches:
            own = [sorted(place[w] for w in names & word_set(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32()))], ["kind", "own"])

    rows = sample.mapInArrow(find, "kind int, own array<int>").collect()  # at most the two bounds
    parts = [Presence(sorted(r["own"] for r in rows if r["kind"] == kind), len(words)) for kind in (1, 0)]
    weights, bias = nnpu_fit(*parts, prior)
    return Model(words, weights, bias, prior)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per document: id, held_out, score in [0, 1], predicted.

    Null and empty texts get the score of a text without words.  Null ids are
    held out as false.  Repeated rows score alike, texts of any length count
    whole, further columns are not read, and no rows give no rows.
    """
    bound_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f(x) for x in batch.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(scored, f"`{id_col}` {kind}, score double")
    return out.select(id_col, F.coalesce(held_out(F.col(id_col), folds), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``; columns as they are."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([f(x) < limit for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def fold_of(doc_id: int, folds: int = 5) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
