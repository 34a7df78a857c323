"""Search of many queries by an index of n-grams, initials and characters, equal to a scan of all records.

A query can only be contained in a field, or in its initials, that has all
its grams: the postings of its rarest gram hold all such fields.  Fields that
hold its characters in any order come last in every answer, so they are
looked up by its rarest character, the records of the highest confidence
first, and only for queries whose answer is not full yet.

Fields of one text fare alike in every query, and so do fields of the same
characters where only these count.  So queries meet different texts and
different sets of characters, each query text once, and of those that fit
only the first records are fetched: as many as an answer holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldweave.functions.text import compact, initials
from goldweave.operators.golden import rule_score, text_fields
from goldweave.operators.graph import rank_rows, settled
from goldweave.sources.store import Store

GRAM = 3
#: Places in the order of confidence up to which the rounds look for loose matches; the last one goes through the rest.
PLACES = (1_000, 20_000, 400_000)


@dataclass
class SearchIndex:
    """``fields`` (entity_id, confidence, place, c, i), ``grams`` (kind, gram, c, i), ``sizes`` (kind, gram, n), ``chars`` (m, place, entity_id).

    ``grams`` and ``sizes`` are over different texts; ``m`` is the characters
    of a text, each once.
    """

    fields: DataFrame
    grams: DataFrame
    sizes: DataFrame
    chars: DataFrame

    def save(self, store: Store) -> None:
        change = store.change()
        for name in ("fields", "grams", "sizes", "chars"):
            change.replace(f"search_{name}", getattr(self, name))
        change.commit()

    @classmethod
    def load(cls, store: Store) -> SearchIndex:
        return cls(*(store.read(f"search_{n}") for n in ("fields", "grams", "sizes", "chars")))


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of ``size`` characters; a shorter text gives none."""
    size = size if isinstance(size, Column) else F.lit(size)
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda k: F.substring(text, k, size)))).otherwise(F.array().cast("array<string>"))


def build(records: DataFrame, names: list[str]) -> SearchIndex:
    """The index of records (entity_id, confidence, and the text or array columns ``names``)."""
    ranked = rank_rows(records, [-F.coalesce("confidence", F.lit(-1.0)), F.col("entity_id")], "place")
    each = ranked.select("entity_id", "confidence", "place", F.explode(F.array_distinct(text_fields(records, names))).alias("f"))
    fields = settled(each.select("entity_id", "confidence", "place", compact(F.col("f")).alias("c"), initials(F.col("f")).alias("i")).where("c <> ''").distinct())

    forms = settled(fields.select("c", "i").distinct())

    def posted(kind: str) -> DataFrame:
        runs = F.array_distinct(F.concat(*[_grams(F.col(kind), n) for n in range(1, GRAM + 1)]))
        return forms.select(F.lit(kind).alias("kind"), F.explode(runs).alias("gram"), "c", "i")

    grams = settled(posted("c").unionByName(posted("i")))
    sizes = settled(grams.groupBy("kind", "gram").agg(F.count("*").alias("n")))
    chars = fields.select(_held(F.col("c")).alias("m"), "place", "entity_id").distinct()
    return SearchIndex(fields, grams, sizes, settled(chars))


def _held(text: Column) -> Column:
    """The distinct characters of a text, in order."""
    return F.array_join(F.array_sort(_grams(text, 1)), "")


def _rarest(asked: DataFrame, sizes: DataFrame, kind: str, size: Column) -> DataFrame:
    """``asked`` (q and others) with each query's gram of fewest postings; queries with a gram that no field has are left out."""
    each = asked.select("*", F.explode(_grams(F.col("q"), size)).alias("gram"))
    found = each.join(sizes.where(F.col("kind") == kind).select("gram", "n"), "gram", "left")
    best = found.groupBy(*asked.columns).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    return best.where("g.n > 0").select(*asked.columns, F.col("g.gram").alias("gram"))


def _first(rows: DataFrame, by: list[str], order: list[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def _answers(rows: DataFrame, limit: int) -> DataFrame:
    """(q, entity_id, place, score): the ``limit`` best records of each query text, each by its best score."""
    return settled(_first(rows.groupBy("q", "entity_id", "place").agg(F.max("score").alias("score")), ["q"], [F.desc("score"), "place"], limit).drop("rank"))


def search_all(index: SearchIndex, queries: DataFrame, *, limit: int = 10, places: tuple[int, ...] = PLACES) -> DataFrame:
    """(query_id, entity_id, score, rank): the ``limit`` best records of each of ``queries`` (query_id, query).

    Records come by their best rule over all fields, then by confidence, then
    by id.  Queries without letters or digits have no answer; an id that is
    repeated with other texts is as many queries.
    """
    limit = min(max(limit, 1), 100)
    asked = settled(queries.select("query_id", compact(F.coalesce("query", F.lit(""))).alias("q")).where("q <> ''").distinct())
    texts = settled(asked.select("q").distinct())
    met = None
    for kind in ("c", "i"):
        by = _rarest(texts, index.sizes, kind, F.least(F.length("q"), F.lit(GRAM)))
        held = by.join(index.grams.where(F.col("kind") == kind), "gram").where(F.contains(F.col(kind), F.col("q"))).select("q", "c", "i")
        met = held if met is None else met.unionByName(held)
    met = met.distinct().withColumn("score", rule_score(F.col("c"), F.col("i"), F.col("q"))).where("score is not null")
    # A record behind as many others of its text can't be among the best.
    tops = _first(index.fields.select("c", "i", "place", "entity_id"), ["c", "i"], ["place"], limit).drop("rank")
    found = _answers(met.join(tops, ["c", "i"]), limit)
    alike = settled(_first(index.chars, ["m"], ["place"], limit).drop("rank"))
    at = 0
    for to in (*places, None):
        full = found.groupBy("q").agg(F.count("*").alias("k")).where(F.col("k") >= limit)
        open_ = settled(texts.join(full, "q", "left_anti").select(F.col("q").alias("text"), _held(F.col("q")).alias("q")))
        if open_.isEmpty():
            break
        block = settled(alike.where((F.col("place") > at) & (F.col("place") <= to) if to else F.col("place") > at))
        by = _rarest(open_.select("q").distinct(), index.sizes, "c", F.lit(1))
        sets = block.select("m").distinct().select("m", F.explode(_grams(F.col("m"), 1)).alias("gram"))
        fits = by.join(sets, "gram").where(F.forall(F.split("q", ""), lambda x: F.contains(F.col("m"), x))).select("q", "m")
        # Of these fewer than ``limit`` are found already, by a better rule.
        more = _first(fits.join(block, "m").select("q", "place", "entity_id").distinct(), ["q"], ["place"], limit)
        more = more.join(open_, "q").select(F.col("text").alias("q"), "entity_id", "place", F.lit(0.48).alias("score"))
        found = _answers(found.unionByName(more), limit)
        at = to
    return _first(found.join(asked, "q"), ["query_id", "q"], [F.desc("score"), "place"], limit).select("query_id", "entity_id", "score", "rank")
