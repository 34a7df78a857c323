"""Text normalisation and token similarity as Column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Canonical names of brands and makers.
BRAND_ALIASES = {
    "ms": "microsoft",
    "microsoft corp": "microsoft",
    "microsoft corporation": "microsoft",
    "adobe systems": "adobe",
    "adobe systems incorporated": "adobe",
    "intuit inc": "intuit",
    "symantec corporation": "symantec",
    "ca": "computer associates",
}
MANUFACTURER_ALIASES = {
    "broderbund software": "broderbund",
    "sage software inc": "sage software",
    "microsoft corporation": "microsoft",
    "adobe systems": "adobe",
    "adobe systems incorporated": "adobe",
}
# Words that say little about a product.
STOPWORDS = [
    "a", "an", "and", "bundle", "cd", "complete", "download", "dvd", "edition", "for", "in", "mac", "new", "of",
    "package", "pack", "pc", "software", "the", "to", "version", "win", "windows", "with",
]
# What marks the side of a column in tables of pairs.
SIDE_PREFIXES = ["table1.", "table2.", "ltable_", "rtable_", "left_", "right_"]


@F.pandas_udf(StringType())
def _full_forms(s: pd.Series) -> pd.Series:
    # Not over an iterator: Spark gives each such function a worker of its own, and these share one.
    return s.map(lambda x: None if x is None else html.unescape(unicodedata.normalize("NFKC", x)))


def normalize_text(value: Column, *, ascii_only: bool = False) -> Column:
    """Lower-case words joined by single spaces; null is empty.

    Order: character forms (NFKC), HTML 5 references, tags, case, punctuation,
    white space.  Texts with characters beyond ASCII or an ampersand, which
    alone the first two change, go through Python in Arrow batches; all others
    stay in the JVM.  ``ascii_only`` leaves that step out.
    """
    x = F.coalesce(value.cast("string"), F.lit(""))
    if not ascii_only:
        x = F.coalesce(_full_forms(F.when(x.rlike("[^\\x00-\\x7F]|&"), x)), x)
    x = F.regexp_replace(F.lower(F.regexp_replace(x, "<[^>]+>", " ")), r"\p{Punct}", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_scalar(value: Column) -> Column:
    """The text with single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", " "))


def folded(value: Column) -> Column:
    """``clean_scalar`` in lower case, for comparisons of titles."""
    return F.lower(clean_scalar(value))


def clean_quotes(value: Column) -> Column:
    """Without the matching quotes around the whole text, however many layers, and with doubled quotes as one."""
    x = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    # Layers of quotes at the start meet the same layers in reverse order at the end.
    heads = F.regexp_extract(x, r"^((?:[\"']\s*)*)", 1)
    ends = F.reverse(F.regexp_extract(x, r"((?:\s*[\"'])*)$", 1))
    marks = lambda c: F.split(F.regexp_replace(c, r"\s", ""), "")
    same = F.zip_with(marks(heads), marks(ends), lambda p, q: F.coalesce((p == q) & (p != ""), F.lit(False)))
    odd = F.array_position(F.transform(same, lambda t: t.cast("int")), 0)
    paired = F.when(odd == 0, F.size(same)).otherwise(odd - 1)
    layers = F.least(paired, F.floor(F.length(F.regexp_replace(x, r"\s", "")) / 2)).cast("int")
    inner = F.aggregate(
        F.when(layers > 0, F.sequence(F.lit(1), layers)).otherwise(F.array().cast("array<int>")), x, lambda t, _: F.trim(t.substr(F.lit(2), F.length(t) - 2))
    )
    return F.trim(F.replace(inner, F.lit('""'), F.lit('"')))


def field_name(name: str) -> str:
    """A column's name without the mark of its side."""
    text = name.strip()
    return next((text[len(p) :] for p in SIDE_PREFIXES if text.lower().startswith(p)), text)


def _alias(norm: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*pairs)[norm]


def normalize_brand(value: Column) -> Column:
    norm = normalize_text(value)
    return F.coalesce(_alias(norm, BRAND_ALIASES), norm)


def normalize_manufacturer(value: Column) -> Column:
    norm = normalize_text(value)
    return F.coalesce(_alias(norm, MANUFACTURER_ALIASES), _alias(norm, BRAND_ALIASES), norm)


def tokens(norm: Column) -> Column:
    """Distinct words of a normalised text."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda t: t != ""))


def important_tokens(norm: Column) -> Column:
    stop = F.array(*[F.lit(x) for x in STOPWORDS])
    return F.filter(F.array_except(tokens(norm), stop), lambda t: F.length(t) > 1)


def number_tokens(norm: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))


def _set_ratio(l: Column, r: Column, ratio: Column) -> Column:  # noqa: E741
    nl, nr = F.size(l), F.size(r)
    return F.when((nl == 0) & (nr == 0), 1.0).when((nl == 0) | (nr == 0), 0.0).otherwise(ratio)


def jaccard(l: Column, r: Column) -> Column:  # noqa: E741
    """Shared over all tokens; both empty 1, one empty 0."""
    common = F.size(F.array_intersect(l, r))
    return _set_ratio(l, r, common / (F.size(l) + F.size(r) - common))


def containment(l: Column, r: Column) -> Column:  # noqa: E741
    return _set_ratio(l, r, F.size(F.array_intersect(l, r)) / F.least(F.size(l), F.size(r)))


def exact_set(l: Column, r: Column) -> Column:  # noqa: E741
    common = F.size(F.array_intersect(l, r))
    return _set_ratio(l, r, ((common == F.size(l)) & (common == F.size(r))).cast("double"))


def length_ratio(l: Column, r: Column) -> Column:  # noqa: E741
    a, b = F.length(l), F.length(r)
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def same_first_token(l: Column, r: Column) -> Column:  # noqa: E741
    a, b = F.split(l, " ")[0], F.split(r, " ")[0]
    return ((a != "") & (a == b)).cast("int")


def manufacturer_similarity(l: Column, r: Column) -> Column:  # noqa: E741
    """Missing 0.5, equal 1, else token overlap; on normalised names."""
    return F.when((l == "") | (r == ""), 0.5).when(l == r, 1.0).otherwise(jaccard(tokens(l), tokens(r)))


def compact(value: Column) -> Column:
    """Letters, digits and CJK characters only, lower-cased."""
    return F.lower(F.regexp_replace(value, "[^0-9a-zA-Z一-鿿]", ""))


def initials(value: Column) -> Column:
    words = F.filter(F.split(F.lower(value), "[^0-9a-z一-鿿]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def _cut(text: Column, n: int):
    return lambda i: F.substring(text, i, n)


def words(norm: Column) -> Column:
    """The words of a normalised text, with repeats."""
    return F.filter(F.split(norm, " "), lambda t: t != "")


def char_ngrams(norm: Column, low: int = 3, high: int = 5) -> Column:
    """N-grams of words padded by a space on either side, with repeats."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(w) + 2
        parts = []
        for n in range(low, high + 1):
            at = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
            grams = F.transform(at, _cut(padded, n))
            parts.append(F.when(size >= n, grams).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    words = F.filter(F.split(norm, " "), lambda t: t != "")
    return F.flatten(F.transform(words, of_word))


def word_ngrams(norm: Column) -> Column:
    """Words of two characters or more, and pairs of such neighbours."""
    words = F.filter(F.split(norm, " "), lambda t: F.length(t) >= 2)
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.concat(words, pairs)
