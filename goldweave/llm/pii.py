"""Personal data: patterns propose, checksums confirm, context words weigh.

Everything is Column expressions.  The kinds email, ip, card and phone are the
base kinds, which always stay once their check holds.  The method adds IBANs
that pass mod-97 and social security numbers that a context word supports, and
gives every span a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.spans import SPANS, guarded, in_order

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn"]

# A match may start where the one before ended, or where no character before could belong to it.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: As one word, or in groups of four as it is printed.
_IBAN = r"\b[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)\b"
_SSN = r"\b[0-9]++-[0-9]++-[0-9]++\b"
_BYTE_VALUE = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)$"

#: Score of a confirmed match without context, words nearby that support it, and what they add.
SCORES = {
    "email": (0.90, "e-?mails?|mails?|contact|write to", 0.05),
    "ip": (0.60, "ip|hosts?|servers?|address|addresses", 0.20),
    "card": (0.70, "cards?|visa|mastercard|credit|payments?", 0.25),
    "phone": (0.60, "calls?|phones?|telephone|tel|mobile|fax", 0.25),
    "iban": (0.80, "iban|banks?|accounts?", 0.15),
    "ssn": (0.30, "ssn|social security", 0.50),
}
CONTEXT_CHARS, KEEP_FROM = 32, 0.5


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string holds."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, 1).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code without blanks leaves 1 by the mod-97 rule; letters count from A = 10."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        point = F.ascii(F.substring(turned, i, 1))
        return F.when(point < 58, (rest * 10 + point - 48) % 97).otherwise((rest * 100 + point - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(s: Column) -> Column:
    value, kind = s["value"], s["kind"]
    digits = digits_of(value)
    count = F.length(digits)
    byte_parts = F.forall(F.split(value, r"\."), lambda p: p.rlike(_BYTE_VALUE))
    groups = F.split(value, "-")
    bare = F.replace(value, F.lit(" "), F.lit(""))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", byte_parts)
        .when(kind == "card", F.when(count.between(12, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", count.between(9, 15))
        .when(kind == "iban", F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(F.lit(False)))
        .otherwise((F.length(groups[0]) == 3) & (F.length(groups[1]) == 2) & (F.length(groups[2]) == 4))
    )


def _scored(s: Column, text: Column) -> Column:
    around = F.lower(F.concat_ws(" ", text.substr(F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS))), text.substr(s["end"] + 1, F.lit(CONTEXT_CHARS))))
    score = F.lit(0.0)
    for kind, (base, words, more) in SCORES.items():
        score = F.when(s["kind"] == kind, F.lit(base) + F.when(around.rlike(rf"\b(?:{words})\b"), F.lit(more)).otherwise(F.lit(0.0))).otherwise(score)
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), score.alias("score"))


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: id and spans, array<struct<kind, start, end, value, score>> in order.

    Places are code points of the whole text, the end exclusive.  Base kinds
    stay whatever their score; added kinds need ``keep_from``.  Null and empty
    texts have no spans; null ids and repeated rows are kept as they are; other
    columns are not read.  No rows give no rows.
    """
    t = F.col("__text")
    out = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    dashed = t.rlike("[0-9]-[0-9]")
    # Cards have 12 digits or more, so texts without a long enough chain need no positions.
    chain = t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    out = out.select(
        "__id", "__text",
        guarded(t, F.contains(t, F.lit("@")), _EMAIL, "email").alias("__email"),
        guarded(t, t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _IP, "ip").alias("__ip"),
        guarded(t, chain, _CARD, "card").alias("__card"),
        guarded(t, t.rlike(r"\+[0-9]"), _PHONE, "phone").alias("__phone"),
        guarded(t, t.rlike(r"[A-Z][A-Z][0-9][0-9]\x20?[A-Z0-9]{4}"), _IBAN, "iban").alias("__iban"),
        guarded(t, dashed, _SSN, "ssn").alias("__ssn"),
    )
    every = F.filter(F.concat(*[F.col(f"__{k}") for k in KINDS]), _confirmed)
    out = out.select("__id", "__text", every.cast(SPANS).alias("__all"))
    scored = F.transform(F.col("__all"), lambda s: _scored(s, t))
    out = out.select("__id", scored.alias("__all"))
    kept = F.filter(F.col("__all"), lambda s: s["kind"].isin(BASE_KINDS) | (s["score"] >= keep_from))
    return out.select(F.col("__id").alias(id_col), in_order(kept, KINDS).alias("spans"))
