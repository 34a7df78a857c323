"""Spans of regular-expression matches as Column expressions.

Spark has no function for the places of all matches, but the pieces between
matches and the matches themselves have the places as running sums of their
lengths.  Patterns are written with possessive quantifiers, which match the
same texts here and neither recurse nor backtrack on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a name bound to ``value``: its uses don't evaluate the expression again."""
    return F.get(F.transform(F.array(value), body), 0)


def found_spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of the leftmost non-overlapping matches; code points, end exclusive.

    Running sums go over blocks of matches and then over blocks, so that many
    matches cost far less than the square of their number.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    return let(F.filter(zipped, lambda p: p["hit"].isNotNull()), lambda pairs: _placed(pairs, kind))


def _placed(pairs: Column, kind: str) -> Column:
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / F.lit(_BLOCK)).cast("int")),
        lambda b: _running(F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)), kind),
    )
    joined = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out")),
        lambda acc, b: F.struct(
            (acc["at"] + b["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.transform(b["out"], lambda s: _moved(s, acc["at"])))).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(F.size(pairs) > 0, joined).otherwise(F.array().cast(SPANS))


def _moved(s: Column, by: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))


def _running(pairs: Column, kind: str) -> Column:
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["hit"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        F.lit(kind).alias("kind"),
                        (acc["at"] + p["gap"]).alias("start"),
                        (acc["at"] + p["gap"] + F.length(p["hit"])).alias("end"),
                        p["hit"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
    )


def guarded(text: Column, needs: Column, pattern: str, kind: str) -> Column:
    """``found_spans`` only where the cheap test ``needs`` holds."""
    return F.when(needs, found_spans(text, pattern, kind)).otherwise(F.array().cast(SPANS))


def in_order(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by the order of ``kinds``, then by end."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("r"), s["end"].alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def joined(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
