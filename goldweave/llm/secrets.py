"""Secret scan: assigned values, access keys, hex runs, and strings of high entropy.

Everything is Column expressions.  The base kinds assign, access and hex stay
whenever they are long enough.  The method adds spans of kind entropy: runs of
base64 or hex characters in which the Shannon entropy of some window of
``WINDOW`` characters reaches its class's limit.  One fold goes over a run: a
character that enters and one that leaves change two counts and the sum of
c * log2(c), from which the entropy of the window follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.spans import SPANS, guarded, in_order, let

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "entropy"]
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
_ASSIGN_HEAD = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?"
_ACCESS = "AKIA[A-Z0-9]{14,}+"
_HEX = "[0-9a-f]{16,}+"
WINDOW = 20
_RUN = r"[A-Za-z0-9+/_=-]{20,}+"
#: Characters of the two classes, whose places are the indices of the counts.
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy in bits of a window of 20: 4.3 is the most; words of prose stay below 3.5.
LIMITS = {"base64": 3.8, "hex": 3.1}
#: Placeholders, around which a run is judged in parts.
PLACEHOLDERS = "(?i)example|placeholder|changeme|dummy|sample|lorem|xxxx|0000|1234567890|abcdef"
#: Runs without letters or without digits are identifiers, numbers and rules, unless their case changes as in random letters.
PLAIN = "^[A-Za-z+/_=-]*$|^[0-9+/_=-]*$"
MIXED = "[A-Z][a-z]{1,2}[A-Z].*[A-Z][a-z]{1,2}[A-Z]"


def _c_log_c(c: Column) -> Column:
    table = F.array(*[F.lit(0.0 if i < 2 else i * math.log2(i)) for i in range(WINDOW + 2)])
    return F.element_at(table, c + 1)


def highest_entropy(run: Column) -> Column:
    """The highest entropy in bits of a window of ``WINDOW`` characters of ``run``, by incremental counts."""
    none = F.array_repeat(F.lit(0), len(_BASE64) + 1)
    start = F.struct(none.alias("counts"), F.lit(0.0).alias("s"), F.lit(WINDOW * math.log2(WINDOW)).alias("least"))

    def step(codes: Column, acc: Column, i: Column) -> Column:
        enter = F.get(codes, i)
        leave = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
        gained = F.element_at(acc["counts"], enter + 1)
        with_new = acc["s"] + _c_log_c(gained + 1) - _c_log_c(gained)
        lost = F.element_at(acc["counts"], F.greatest(leave, F.lit(0)) + 1) + F.when(leave == enter, F.lit(1)).otherwise(F.lit(0))
        total = F.when(leave >= 0, with_new + _c_log_c(lost - 1) - _c_log_c(lost)).otherwise(with_new)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == enter, F.lit(1)).otherwise(F.lit(0)) - F.when(k == leave, F.lit(1)).otherwise(F.lit(0)))
        least = F.when(i >= WINDOW - 1, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), total.alias("s"), least.alias("least"))

    def folded(codes: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, lambda acc, i: step(codes, acc, i), lambda acc: acc["least"])

    # The run is split into characters once: to take each by its place would walk the run from its start.
    codes = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(_BASE64), c))
    return F.lit(math.log2(WINDOW)) - let(codes, folded) / F.lit(float(WINDOW))


def _secret_like(s: Column) -> Column:
    value = s["value"]
    limit = F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(LIMITS["hex"])).otherwise(F.lit(LIMITS["base64"]))
    parts = F.filter(F.split(value, PLACEHOLDERS), lambda x: F.length(x) >= WINDOW)
    high = F.exists(parts, lambda x: highest_entropy(x) >= limit)
    return F.when(value.rlike(PLAIN) & ~value.rlike(MIXED), F.lit(False)).otherwise(high)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, array<struct<kind, start, end, value>> in order.

    Places are code points of the whole text, the end exclusive; an assign span
    is the whole match.  Null and empty texts have no spans; null ids and
    repeated rows are kept as they are; other columns are not read.  No rows
    give no rows.
    """
    t = F.col("__text")
    out = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    out = out.select(
        "__id",
        guarded(t, t.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"'\x20:=]"), _ASSIGN, "assign").alias("__assign"),
        guarded(t, F.contains(t, F.lit("AKIA")), _ACCESS, "access").alias("__access"),
        guarded(t, t.rlike("[0-9a-f]{16}"), _HEX, "hex").alias("__hex"),
        guarded(t, t.rlike(_RUN), _RUN, "entropy").alias("__entropy"),
    )
    value = lambda s: F.regexp_replace(s["value"], _ASSIGN_HEAD, "")
    assign = F.filter("__assign", lambda s: F.length(value(s)) >= 12)
    entropy = F.filter("__entropy", _secret_like)
    every = F.concat(assign, "__access", "__hex", entropy).cast(SPANS)
    return out.select(F.col("__id").alias(id_col), in_order(every, KINDS).alias("spans"))


def redact_secrets(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each run of secret spans replaced by ``mark``; same rows, columns and types.

    ``chars_col``, where there is such a column, is set to the new length of a
    text that changed.  Null texts stay null.
    """
    names = docs.columns
    spans = find_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text")), id_col="row")
    text = F.col(f"row.`{text_col}`")
    # A span that starts within what is already covered moves the end only.
    marks = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,to:int>>").alias("keep")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            F.when(s["start"] >= acc["end"], F.concat(acc["keep"], F.array(F.struct(acc["end"].alias("from"), s["start"].alias("to"))))).otherwise(acc["keep"]).alias("keep"),
        ),
    )
    cut = spans.select("row", F.size("spans").alias("n"), F.when(F.size("spans") > 0, marks).alias("m"))
    parts = F.transform("m.keep", lambda k: text.substr(k["from"] + 1, k["to"] - k["from"]))
    rest = text.substr(F.col("m.end") + 1, F.length(text))
    clean = F.when(F.col("n") > 0, F.concat(F.array_join(parts, mark), F.lit(mark), rest)).otherwise(text)
    out = cut.select("row", "n", clean.alias("clean"))
    fields = []
    for f in docs.schema:
        c = F.col(f"row.`{f.name}`")
        if f.name == text_col:
            c = F.col("clean")
        elif f.name == chars_col:
            c = F.when(F.col("n") > 0, F.length("clean")).otherwise(c).cast(f.dataType)
        fields.append(c.alias(f.name))
    return out.select(*fields)
