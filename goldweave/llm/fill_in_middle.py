"""Fill-in-the-middle arrangements as Column expressions.

A text becomes an array of units (white space with the word after it, or the
white space at the end) by ``regexp_extract_all``; numbers taken from a sha256
of seed and id choose two cuts, whether the text is rearranged and in which
form; ``slice`` and ``array_join`` build the arrangement.  A sentinel begins
with its only ``<`` and ends with its only ``>``, so the three of an
arrangement are the only ones in it and parsing restores the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seed, percentage of rearranged texts, and of suffix-first ones among them.
SEED, RATE, SPM_RATE = 42, 50, 80
#: The sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
# Possessive quantifiers match the same units and never backtrack on long runs of white space.
_UNITS = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


def _number(digest: Column, k: int) -> Column:
    """The ``k``-th group of eight hexadecimal digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    if len(set(sentinels)) != 3 or not all(re.fullmatch("<[^<>]+>", s) for s in sentinels):
        raise ValueError("three different sentinels of the form <...> are needed")
    return sentinels


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``form`` is ``psm``, ``spm`` or ``plain``; a plain text is its own output
    and has null lengths.  Plain are empty texts, texts that hold a sentinel,
    and those the seed leaves as they are.  A null text is empty, a null id is
    hashed as no digits.  Rows that repeat an id get the same numbers.  Texts
    of any length are taken whole; further columns are not read.  No rows give
    no rows.  There is no exchange: each row is one projection.
    """
    before, after, between = (F.lit(s) for s in _checked(sentinels))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    units = F.regexp_extract_all("text", F.lit(_UNITS), F.lit(0))
    rows = rows.select("*", units.alias("units"), *[_number(F.col("digest"), k).alias(f"h{k + 1}") for k in range(4)])
    n = F.size("units").cast("long")
    held = F.col("text").contains(before) | F.col("text").contains(after) | F.col("text").contains(between)
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select(
        "doc_id", "text", "units", n.alias("n"), form.alias("form"),
        F.least(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int").alias("first"), F.greatest(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int").alias("last"),
    )

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))

    first, last = F.col("first"), F.col("last")
    rows = rows.select(
        "doc_id", "text", "n", "form",
        part(F.lit(1), first).alias("prefix"), part(first + 1, last - first).alias("middle"), part(last + 1, F.col("n").cast("int") - last).alias("suffix"),
    )
    psm = F.concat(before, "prefix", after, "suffix", between, "middle")
    spm = F.concat(after, "suffix", before, "prefix", between, "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from, by its sentinels alone; plain ones are returned as they are."""
    before, after, between = _checked(sentinels)

    def at(sentinel: str, stop: str | None) -> Column:
        rest = F.substring_index(output, sentinel, -1)
        return F.substring_index(rest, stop, 1) if stop else rest

    psm = F.concat(at(before, after), at(between, None), at(after, between))
    spm = F.concat(at(before, between), at(between, None), at(after, before))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
