"""Review by people: tasks of open pairs, pages of them, and the choices that are applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators.commit import CANDIDATE
from goldweave.operators.graph import rank_rows


def review_task(pairs: DataFrame, task_id: str) -> DataFrame:
    """The pairs of a task, numbered from 0 by falling confidence."""
    rows = rank_rows(pairs, [-F.col("confidence"), F.col("l_id"), F.col("r_id")], "position")
    return rows.withColumns({"task_id": F.lit(task_id), "status": F.lit("pending"), "position": F.col("position") - 1})


def review_page(task: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    page, size = max(page, 1), min(max(page_size, 1), 200)
    return task.where((F.col("position") >= (page - 1) * size) & (F.col("position") < page * size)).orderBy("position")


def apply_choices(task: DataFrame, choices: DataFrame) -> DataFrame:
    """Candidates of ``choices(position, choice)`` to commit as human decisions; table1 or table2 choose a title, all else skips.

    A side without a title gives way to the second, then to the first.
    """
    wanted = choices.where(F.col("choice").isin("table1", "table2")).dropDuplicates(["position"])
    rows = task.join(wanted, "position")
    title = F.coalesce(F.nullif(F.when(F.col("choice") == "table1", F.col("l_title")), F.lit("")), F.nullif("r_title", F.lit("")), F.nullif("l_title", F.lit("")))
    text = lambda c: F.col(c).cast("string") if c in task.columns else F.lit(None).cast("string")
    more = lambda p: F.col(f"{p}_attributes") if f"{p}_attributes" in task.columns else F.lit(None)
    maker = lambda p: text(f"{p}_manufacturer" if f"{p}_manufacturer" in task.columns else f"{p}_maker")
    side = lambda p: F.struct(text(f"{p}_id").alias("id"), text(f"{p}_title").alias("title"), maker(p).alias("manufacturer"), text(f"{p}_price").alias("price"), more(p).alias("attributes"))
    fields = {x.split(" ", 1)[0]: x.split(" ", 1)[1] for x in _fields(CANDIDATE)}
    made = {
        "cand_id": F.concat_ws(":", "task_id", F.col("position").cast("string")), "title": title, "source": F.lit("human"), "confidence": F.col("confidence"),
        "reason": F.concat(F.lit("manual review task "), "task_id"), "table1": side("l"), "table2": side("r"),
    }
    return rows.select(*[(made[n] if n in made else F.lit(None)).cast(kind).alias(n) for n, kind in fields.items()])


def _fields(schema: str) -> list[str]:
    """The fields of a schema text at its outermost level."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]
