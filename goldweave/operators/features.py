"""Pair features: TF-IDF cosines, BM25, token sets, and the vector of thirteen."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from goldweave.functions import text as T
from goldweave.functions.numeric import price_log_delta, price_similarity
from goldweave.operators import similarity
from goldweave.operators.graph import settled
from goldweave.operators.similarity import B, K1

FEATURES = (
    "char_tfidf_cosine", "word_tfidf_cosine", "title_token_jaccard", "title_bm25_similarity", "important_token_jaccard", "important_token_containment",
    "number_token_jaccard", "number_token_exact_match", "manufacturer_similarity", "price_similarity", "title_length_ratio", "same_first_token", "price_log_delta",
)
LEXICAL = ("char_tfidf_cosine", "word_tfidf_cosine", "title_token_jaccard", "title_bm25_similarity", "important_token_jaccard", "number_token_jaccard")


def term_counts(records: DataFrame, terms: Column) -> DataFrame:
    """(id, term, tf) of each record."""
    return records.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def tfidf_idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) with smoothed idf = ln((1 + N) / (1 + df)) + 1."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1)


def tfidf_vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, term, w) with unit length per record."""
    raw = counts.join(idf.select("term", "idf"), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    # The terms of a record meet once, for its length and its weights.
    own = raw.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("ts"))
    norm = F.sqrt(F.aggregate("ts", F.lit(0.0), lambda acc, t: acc + t["w"] * t["w"]))
    return own.withColumn("norm", norm).select("id", "norm", F.explode("ts").alias("t")).select("id", "t.term", (F.col("t.w") / F.col("norm")).alias("w"))


def _one_array(rows: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
    """(key, name): the rows of each record as one array, sorted by term; a record has as many as its title has terms."""
    return rows.groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("term", *values))).alias(name))


def _met(left: Column, right: Column, weigh) -> Column:
    """The sum of ``weigh(x, y)`` over the terms of both arrays.

    Both arrays together are sorted, so that equal terms are neighbours; a
    fold looks at each element and the one before it.
    """
    both = F.array_sort(F.concat(left, right))
    none = F.get(F.slice(both, 1, 0), 0)
    zero = F.struct(none.alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, x: F.struct(x.alias("last"), F.when(acc["last"]["term"] == x["term"], acc["sum"] + weigh(acc["last"], x)).otherwise(acc["sum"]).alias("sum"))
    return F.coalesce(F.aggregate(both, zero, step, lambda acc: acc["sum"]), F.lit(0.0))


def sparse_dot(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """(l_id, r_id, name): the dot product of each pair's vectors; pairs without a common term give 0.

    Vectors are gathered once per record, and a pair meets one array a side.
    """
    l, r = _one_array(left, "l_id", ["w"], "__l"), _one_array(right, "r_id", ["w"], "__r")  # noqa: E741
    both = pairs.select("l_id", "r_id").join(l, "l_id", "left").join(r, "r_id", "left")
    return both.select("l_id", "r_id", _met(F.col("__l"), F.col("__r"), lambda x, y: x["w"] * y["w"]).alias(name))


def bm25_statistics(records: DataFrame) -> DataFrame:
    """(term, df, idf, n_docs, avg_len) over the distinct tokens of each record."""
    size = records.agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("avg_len"))
    df = records.select("id", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(size)).withColumn("idf", idf)  # the right side is one row


def _bm25_weights(records: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, term, tf, s): the score that one occurrence of a word in another title finds in the record."""
    counts = records.select("id", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    weighted = counts.join(stats.select("term", "idf", "avg_len"), "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1e-9))))
    return weighted.select("id", "term", F.col("tf").cast("double").alias("tf"), part.alias("s"))


def bm25_similarity(pairs: DataFrame, records: DataFrame, stats: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(l_id, r_id, title_bm25_similarity), symmetric and scaled by the larger self score.

    ``records`` has id and words, the words of the title with repeats; with
    ``right``, whose ids may repeat the left ones, it holds the left side only.
    """
    weights = _bm25_weights(records, stats)
    other = weights if right is None else _bm25_weights(right, stats)
    own = lambda p: F.aggregate(F.col(f"__{p}"), F.lit(0.0), lambda acc, x: acc + x["tf"] * x["s"])
    l, r = _one_array(weights, "l_id", ["tf", "s"], "__l"), _one_array(other, "r_id", ["tf", "s"], "__r")  # noqa: E741
    out = pairs.select("l_id", "r_id").join(l, "l_id", "left").join(r, "r_id", "left")
    # Each word of one title, as often as it occurs, looks up its score in the other.
    both = _met(F.col("__l"), F.col("__r"), lambda x, y: x["tf"] * y["s"] + y["tf"] * x["s"])
    top = F.greatest(F.coalesce(own("l"), F.lit(0.0)), F.coalesce(own("r"), F.lit(0.0)), F.lit(1e-9))
    return out.select("l_id", "r_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), both / (2 * top))).alias("title_bm25_similarity"))


def token_features(pairs: DataFrame) -> DataFrame:
    """The features of a pair that need no statistics of the collection; columns of ``blocking.with_sides``."""
    c = F.col
    imp = (T.important_tokens(c("l_norm")), T.important_tokens(c("r_norm")))
    num = (T.number_tokens(c("l_norm")), T.number_tokens(c("r_norm")))
    return pairs.withColumns(
        {
            "title_token_jaccard": T.jaccard(c("l_tokens"), c("r_tokens")),
            "important_token_jaccard": T.jaccard(*imp),
            "important_token_containment": T.containment(*imp),
            "number_token_jaccard": T.jaccard(*num),
            "number_token_exact_match": T.exact_set(*num),
            "manufacturer_similarity": T.manufacturer_similarity(c("l_maker"), c("r_maker")),
            "price_similarity": price_similarity(c("l_price"), c("r_price")),
            "title_length_ratio": T.length_ratio(c("l_norm"), c("r_norm")),
            "same_first_token": T.same_first_token(c("l_norm"), c("r_norm")),
            "price_log_delta": price_log_delta(c("l_price"), c("r_price")),
        }
    )


#: Terms of a title by kind: what the cosines and BM25 count.
KINDS = {"char": T.char_ngrams, "word": T.word_ngrams, "token": T.words}
COUNTS, VOLUMES = "kind string, term string, df long", "n_docs long, words long"


def title_counts(records: DataFrame) -> DataFrame:
    """(kind, term, df): how many titles hold each term.  Counts of disjoint sets of records add up."""
    norm = F.coalesce("title_norm", F.lit(""))

    def tagged(kind: str) -> Column:
        return F.transform(F.array_distinct(KINDS[kind](norm)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    terms = [tagged(kind) for kind in KINDS]
    return records.select(F.explode(F.concat(*terms)).alias("t")).groupBy("t.kind", "t.term").agg(F.count("*").alias("df"))


def title_volumes(records: DataFrame) -> DataFrame:
    """(n_docs, words): titles and their words; one row."""
    return records.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(T.words(F.coalesce("title_norm", F.lit(""))))), F.lit(0)).cast("long").alias("words"))


class FeatureBuilder:
    """Statistics of titles; ``transform`` adds the thirteen features to pairs.

    The statistics are sums, ``counts`` (kind, term, df) and ``volumes``
    (n_docs, words), so those of several sets of records are added by a union.
    """

    def __init__(self, counts: DataFrame, volumes: DataFrame) -> None:
        self.counts, self.volumes = counts, volumes

    @classmethod
    def fit(cls, records: DataFrame) -> FeatureBuilder:
        return cls(title_counts(records), title_volumes(records))

    @staticmethod
    def columns_needed(pairs: DataFrame) -> list[str]:
        return [c for c in ("l_id", "r_id", "l_norm", "r_norm", "l_tokens", "r_tokens", "l_maker", "r_maker", "l_price", "r_price") if c not in pairs.columns]

    def transform(self, pairs: DataFrame, records: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """``pairs`` (columns of ``blocking.with_sides``) with the features.

        The titles come from the left and the right ``records`` (id,
        title_norm) where they are given, else from the pairs themselves.
        """
        if missing := self.columns_needed(pairs):
            raise ValueError(f"pairs lack {missing}")
        size = self.volumes.agg(F.sum("n_docs").alias("n"), F.sum("words").alias("w")).first()
        n, words = size["n"] or 0, size["w"] or 0
        counts = settled(self.counts.groupBy("kind", "term").agg(F.sum("df").alias("df")))
        if records is None:
            pairs = settled(pairs)  # titles and features read the pairs
            records = tuple(pairs.select(F.col(f"{p}_id").alias("id"), F.col(f"{p}_norm").alias("title_norm")) for p in ("l", "r"))
        left, right = (settled(r.select("id", "title_norm").dropDuplicates(["id"])) for r in records)
        held = settled(word_counts(left.unionByName(right), counts).union(counts.where("kind = 'word' and contains(term, ' ')").select("term", F.array(F.col("df").cast("int")))))
        own = {"n": n, "avg_len": words / max(n, 1)}
        # Each side is made by a plan of its own: one plan of all fills the driver.
        left = settled(with_counts(left, held).select(F.col("id").alias("l_id"), F.col("title_norm").alias("l_title"), "held"))
        out = StructType([right.schema["id"], right.schema["title_norm"], *[StructField(c, DoubleType()) for c in ("char_norm", "word_norm", "own")]])
        right = settled(with_counts(right, held).mapInArrow(partial(similarity.lengths, **own, schema=to_arrow_schema(out)), out)).withColumnsRenamed({"id": "r_id", "title_norm": "r_title"})
        met = pairs.select("l_id", "r_id").distinct().join(right, "r_id").join(left, "l_id").select("l_id", "r_id", "l_title", "held", "r_title", "char_norm", "word_norm", "own")
        out = StructType([met.schema["l_id"], met.schema["r_id"], *[StructField(c, DoubleType()) for c in ("char_tfidf_cosine", "word_tfidf_cosine", "title_bm25_similarity")]])
        return token_features(pairs).join(met.mapInArrow(partial(similarity.similarities, **own, schema=to_arrow_schema(out)), out), ["l_id", "r_id"])


def pieces(norm: Column) -> Column:
    """The distinct words of a title and then its pairs of words, in the order of ``similarity.Title``."""
    return F.array_distinct(F.concat(T.words(norm), T.word_ngrams(norm)))


def word_counts(records: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, held) of each word of the titles: how many titles hold it as a word, as a word of the n-grams, and each of its n-grams of characters; 0 if unknown."""
    words = records.select(F.explode(T.words(F.col("title_norm"))).alias("word")).distinct()
    tagged = lambda kind, terms: F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))
    whole = F.array("word")
    each = words.select("word", F.posexplode(F.concat(tagged("token", whole), tagged("word", whole), tagged("char", T.char_ngrams(F.col("word"))))).alias("i", "t"))
    found = each.select("word", "i", "t.kind", "t.term").join(counts, ["kind", "term"], "left").select("word", F.struct("i", F.coalesce("df", F.lit(0)).cast("int").alias("df")).alias("d"))
    return found.groupBy(F.col("word").alias("term")).agg(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["df"]).alias("held"))


def with_counts(records: DataFrame, held: DataFrame) -> DataFrame:
    """(id, title_norm, held): the counts of a title's ``pieces``, one after another."""
    each = records.select("id", F.posexplode(pieces(F.col("title_norm"))).alias("i", "term")).join(held, "term", "left")
    each = each.select("id", F.struct("i", F.coalesce("held", F.array(F.lit(0))).alias("held")).alias("h"))
    own = each.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["held"])).alias("held"))
    return records.join(own, "id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))


def _words(records: DataFrame) -> DataFrame:
    return records.select("id", T.words(F.col("title_norm")).alias("words"))


def lexical_score() -> Column:
    total = F.lit(0.0)
    for name in LEXICAL:
        total = total + F.col(name)
    # Rounded, so that scores that are equal but for the order of a sum share a rank.
    return F.round(total / len(LEXICAL), 9)
