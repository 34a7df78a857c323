"""Candidate pairs by shared tokens; never a cross product."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from goldweave.functions.numeric import normalize_price
from goldweave.functions.text import jaccard, normalize_manufacturer, normalize_text, tokens
from goldweave.operators.cells import join_in_cells
from goldweave.operators.graph import settled
from goldweave.operators.overlap import MANY_TITLES, all_of_blocks, best_of_block

ROUGH, TOP_K, POSTING_RATIO, POSTING_FLOOR = 0.18, 40, 0.08, 25


def postings(right: DataFrame) -> DataFrame:
    """Documents per token of the right side."""
    return right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def token_pairs(left: DataFrame, right: DataFrame, *, cap: int | None = None) -> DataFrame:
    """Distinct (l_id, r_id) that share a token; tokens of more than ``cap`` right rows don't count.

    The cap bounds what one token can produce, so no posting list of a common
    word meets another one.
    """
    l = left.select(F.col("id").alias("l_id"), F.explode("tokens").alias("token"))  # noqa: E741
    r = right.select(F.col("id").alias("r_id"), F.explode("tokens").alias("token"))
    if cap is not None:
        rare = r.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("token")
        r = r.join(rare, "token", "left_semi")
    return l.join(r, "token").select("l_id", "r_id").distinct()


def posting_cap(rows: int, most: int | None = None) -> int:
    """The rule for the cap, a share of the right rows; ``most`` bounds it where tables are large."""
    cap = max(POSTING_FLOOR, int(rows * POSTING_RATIO))
    return cap if most is None else min(cap, most)


def canonical_pairs(left: DataFrame, right: DataFrame, *, rough: float = ROUGH, makers: int | None = None) -> DataFrame:
    """(l_id, r_id, rough_score): pairs by title token, by maker, or with both titles empty, whose maker is the same or whose titles overlap.

    A maker of more than ``makers`` right rows, where that is given, brings no
    pairs of its own: only title tokens do, and then the overlap counts.
    Three joins bring each pair once: titles that overlap, empty titles, and
    equal makers whose titles don't; so pairs are not shuffled.
    """
    one = lambda df: df.withColumn("parts", F.array(F.coalesce("tokens", F.array().cast("array<string>"))))
    near = block_pairs(one(left), one(right), None, weights=[1.0], rough=rough, top_k=None, pairs=OPEN_PAIRS)
    # A key that is a column, as a constant one would be no key of the join.
    blank = lambda df, p: df.where("title_norm = ''").select(F.col("id").alias(f"{p}_id"), F.col("title_norm").alias("key"))
    empty = join_in_cells(blank(left, "l"), blank(right, "r"), "key", "l_id", "r_id").select("l_id", "r_id", F.lit(1.0).alias("rough_score"))
    made = lambda df, p, *keys: df.where("manufacturer_norm <> ''").select(F.col("id").alias(f"{p}_id"), F.col("tokens").alias(f"{p}_t"), *keys)
    if makers is None:
        same = join_in_cells(*(made(df, p, F.col("manufacturer_norm").alias("key")) for df, p in ((left, "l"), (right, "r"))), "key", "l_id", "r_id")
    else:
        few = right.where("manufacturer_norm <> ''").groupBy("manufacturer_norm").agg(F.count("*").alias("n")).where(F.col("n") <= makers).select("manufacturer_norm", F.lit(True).alias("__few"))
        # Rows of a large maker meet by the maker and a token.
        whole = F.when(F.col("__few"), F.array("manufacturer_norm")).otherwise(F.transform("tokens", lambda t: F.concat("manufacturer_norm", F.lit("\n"), t)))
        l, r = (made(df.join(few, "manufacturer_norm", "left"), p, whole.alias(f"{p}_keys")).withColumn("key", F.explode(f"{p}_keys")) for df, p in ((left, "l"), (right, "r")))  # noqa: E741
        same = join_in_cells(l, r, "key", "l_id", "r_id").where((F.size("l_keys") == 1) | (F.get(F.array_intersect("l_keys", "r_keys"), 0) == F.col("key")))
    far = same.select("l_id", "r_id", jaccard(F.col("l_t"), F.col("r_t")).alias("rough_score")).where(F.col("rough_score") < rough)
    return near.unionByName(empty).unionByName(far)


def block_canonical(left: DataFrame, right: DataFrame, *, rough: float = ROUGH, makers: int | None = None) -> DataFrame:
    """``canonical_pairs`` with both records."""
    return with_sides(canonical_pairs(left, right, rough=rough, makers=makers), left, right)


def _side(df: DataFrame, p: str) -> DataFrame:
    raw = [F.col(c).alias(f"{p}_{c}") for c in ("manufacturer", "attributes") if c in df.columns]
    return df.select(
        F.col("id").alias(f"{p}_id"), F.col("title").alias(f"{p}_title"), F.col("title_norm").alias(f"{p}_norm"), F.col("manufacturer_norm").alias(f"{p}_maker"),
        F.col("price_norm").alias(f"{p}_price"), F.col("tokens").alias(f"{p}_tokens"), *raw,
    )


def with_sides(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with what scoring and the master need of both records: normal forms, raw makers, and attributes where there are any."""
    return pairs.join(_side(left, "l"), "l_id").join(_side(right, "r"), "r_id")


def pair_sides(pairs: DataFrame) -> DataFrame:
    """Labeled pairs with the raw columns l_id, l_title, ..., r_price in the columns of ``with_sides``; others stay."""
    out = pairs
    for p in ("l", "r"):
        norm = normalize_text(F.col(f"{p}_title"))
        out = out.withColumns({
            f"{p}_norm": norm, f"{p}_maker": normalize_manufacturer(F.col(f"{p}_manufacturer")), f"{p}_price": normalize_price(F.col(f"{p}_price")), f"{p}_tokens": tokens(norm),
        })
    return out


def rough_score(l_parts: Column, r_parts: Column, weights: list[float]) -> Column:
    """Weighted overlap of the columns' tokens; columns that are empty on both sides don't count."""
    total, used = F.lit(0.0), F.lit(0.0)
    for i, w in enumerate(weights):
        if w > 0:
            l, r = F.get(l_parts, i), F.get(r_parts, i)  # noqa: E741
            some = (F.size(l) > 0) | (F.size(r) > 0)
            total = total + F.when(some, F.lit(w) * jaccard(l, r)).otherwise(0.0)
            used = used + F.when(some, F.lit(w)).otherwise(0.0)
    return F.when(used > 0, total / used).otherwise(0.0)


#: Pairs of rows whose tokens one task compares.
TOKEN_PAIRS = 1 << 33
#: The same where rows have one column and are many: a task's work grows with both sides rather than with their product.
TITLE_PAIRS = 1 << 35
#: The same where all pairs leave the task, those of one left row after another's.
OPEN_PAIRS = 1 << 32
#: Blocks of the left side that are made where it has some thousand rows, so that many tasks share the work.
LEFT_BLOCKS, BLOCK_ROWS = 24, 1 << 10
#: The same where ``TITLE_PAIRS`` holds; each block prepares the right rows anew.
TITLE_BLOCKS = 12


#: Partitions for each task's blocks, so that few meet in one by their hash, and at most how many for that.
SPREAD, TITLE_SPREAD, MOST_SPREAD = 4, 24, 512


def _blocks(n_left: int, n_right: int, pairs: int | None = None, most: int = LEFT_BLOCKS) -> tuple[int, int]:
    """Into how many blocks both sides are cut, so that no two blocks have more than ``pairs`` pairs of rows, ``TOKEN_PAIRS`` if not given."""
    pairs = pairs or TOKEN_PAIRS
    r_rows = max(1, math.isqrt(4 * pairs))
    l_rows = max(1, pairs // r_rows)
    return max(1, -(-n_left // l_rows), min(most, -(-n_left // BLOCK_ROWS))), max(1, -(-n_right // r_rows))


def block_pairs(left: DataFrame, right: DataFrame, keys: DataFrame | None, *, weights: list[float], rough: float, top_k: int | None, pairs: int | None = None) -> DataFrame:
    """(l_id, r_id, rough_score) of pairs that share a key, and score ``rough`` or more.

    With several weights ``keys`` (id, keys) has the right rows' keys, and
    other rows take no part.  With one all tokens are keys but those of
    ``keys`` (id, common), if that is given.

    Both sides are dealt into blocks, and each left block meets each right one
    in a task that holds no more than these two.  There a left row adds up the
    posting lists of its tokens, so a pair costs one addition for each token
    that it shares; rows of one column and many right ones meet by their first
    common tokens instead.  Only the ``top_k`` best of a block leave it, or all
    without that.  Tokens of a row are distinct.
    """
    none = F.array().cast("array<string>")
    parts = [F.coalesce(F.get("parts", i), none).alias(f"p{i}") for i in range(len(weights))]
    l, r = left.where(F.size("tokens") > 0), right.where(F.size("tokens") > 0)  # noqa: E741
    if len(weights) == 1:
        l, r = l.select("id", *parts), r.select("id", *parts)  # noqa: E741
        r = r.withColumn("common", none) if keys is None else r.join(keys, "id", "left").withColumn("common", F.coalesce("common", none))
    else:
        l, r = l.select("id", F.col("tokens").alias("keys"), *parts), r.select("id", *parts).join(keys, "id")  # noqa: E741
    l, r = settled(l), settled(r)  # noqa: E741
    n_left, n_right = l.count(), r.count()
    titles = len(weights) == 1 and pairs is None and n_right >= MANY_TITLES
    n_l, n_r = _blocks(n_left, n_right, TITLE_PAIRS, TITLE_BLOCKS) if titles else _blocks(n_left, n_right, pairs)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Columns of their own: both sides may come from one table.
    fresh = lambda df: [F.col(c).alias(c) for c in df.columns]
    l = l.select(*fresh(l), deal(n_l).alias("__l"), every(n_r).alias("__r"))  # noqa: E741
    r = r.select(*fresh(r), deal(n_r).alias("__r"), every(n_l).alias("__l"))
    # A number of partitions that is named stays; few large ones would leave cores idle.
    n = max(n_l * n_r, min((TITLE_SPREAD if titles else SPREAD) * n_l * n_r, MOST_SPREAD))
    out = StructType([StructField("l_id", left.schema["id"].dataType), StructField("r_id", right.schema["id"].dataType), StructField("rough_score", DoubleType())])
    if len(weights) == 1 and top_k is None:
        # All pairs of a block are more than a task should hold, so they leave it as they are found.
        both = r.withColumn("__left", F.lit(False)).unionByName(l.withColumns({"common": none, "__left": F.lit(True)}))
        both = both.repartition(n, "__l", "__r").sortWithinPartitions("__l", "__r", "__left", "id")
        return both.mapInArrow(partial(all_of_blocks, rough=rough, schema=to_arrow_schema(out)), out)
    l, r = (df.repartition(n, "__l", "__r") for df in (l, r))  # noqa: E741
    best = partial(best_of_block, weights=weights, rough=rough, top_k=top_k, schema=to_arrow_schema(out))
    return l.groupBy("__l", "__r").cogroup(r.groupBy("__l", "__r")).applyInArrow(lambda a, b: best(a, b), out)


def top_candidates(left: DataFrame, right: DataFrame, *, cap: int, weights: list[float], rough: float = ROUGH, top_k: int = TOP_K) -> DataFrame:
    """(l_id, r_id, rough_score, rank): the ``top_k`` best pairs of each left row that share a token of at most ``cap`` right rows."""
    counts = right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = right.select("id", F.explode("tokens").alias("token"))
    if len(weights) == 1:
        keys = each.join(counts.where(F.col("n") > cap).select("token"), "token", "left_semi").groupBy("id").agg(F.collect_list("token").alias("common"))
    else:
        keys = each.join(counts.where(F.col("n") <= cap).select("token"), "token", "left_semi").groupBy("id").agg(F.collect_list("token").alias("keys"))
    return settled(top_per_left(block_pairs(left, right, keys, weights=weights, rough=rough, top_k=top_k), top_k))


def block_schema(
    left: DataFrame, right: DataFrame, *, cap: int, weights: list[float] | None = None, blocking: list[int] | None = None, rough: float = ROUGH, top_k: int = TOP_K
) -> DataFrame:
    """Pairs by capped blocking tokens with a rough score of ``rough`` or more; the ``top_k`` best per left row, ties by right id.

    ``parts`` holds the tokens of each column, ``weights`` their weights;
    ``tokens`` are the blocking ones, those of the columns at the places
    ``blocking``.  Without weights they are the only column.  A left row to which the tokens bring no candidate is
    compared with the right rows that have no blocking token at all.  Such a
    pair can only score by a token of another column, so these meet by those
    tokens.  Pairs are scored on tokens alone, and only the best fetch their
    records.
    """
    if weights is None:
        weights, blocking = [1.0], [0]
        left, right = (df.withColumn("parts", F.array("tokens")) for df in (left, right))
    top = top_candidates(left, right, cap=cap, weights=weights, rough=rough, top_k=top_k)
    if len(weights) > 1:
        # A left row brings no candidate where none of its tokens counts.
        rare = right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") <= cap)
        brought = left.select("id", F.explode("tokens").alias("token")).join(rare, "token", "left_semi").select("id").distinct()
        every = F.array_distinct(F.flatten("parts")).alias("tokens")
        bare = right.where(F.size("tokens") == 0).select("id", every)
        pairs = token_pairs(left.join(brought, "id", "left_anti").select("id", every), bare)
        slim = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("parts").alias(f"{p}_parts"))
        more = pairs.join(slim(left, "l"), "l_id").join(slim(right, "r"), "r_id")
        more = more.select("l_id", "r_id", rough_score(F.col("l_parts"), F.col("r_parts"), weights).alias("rough_score")).where(F.col("rough_score") >= rough)
        top = top.unionByName(top_per_left(more, top_k))
    return with_sides(top, left, right)


def top_per_left(scored: DataFrame, top_k: int = TOP_K) -> DataFrame:
    w = Window.partitionBy("l_id").orderBy(F.desc("rough_score"), "r_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
