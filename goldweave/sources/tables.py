"""Reading and writing the engine's tables."""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.functions.jsontext import is_json
from goldweave.functions.text import field_name
from goldweave.sources import split_csv

# Texts that stand for a missing value in CSV files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Keys of a reference to a file, in the order in which they count.
_KEYS = ("url", "source_url", "preview_url", "remote_url", "original_url", "path")


def resolve_reference(reference: object) -> str:
    """A path from a text, a JSON text or a mapping with one of the known keys."""
    if reference is None:
        return ""
    if isinstance(reference, dict):
        return next((str(reference[k]) for k in _KEYS if reference.get(k)), "")
    text = str(reference).strip()
    if text.startswith("{"):
        try:
            return resolve_reference(json.loads(text))
        except ValueError:
            return text
    return text


# Encodings that are tried in this order.
ENCODINGS = ["UTF-8", "ISO-8859-1"]


def valid_encoding(spark: SparkSession, path: str) -> str:
    """The first of ``ENCODINGS`` by which no line holds a replacement character."""
    for encoding in ENCODINGS[:-1]:
        lines = spark.read.option("encoding", encoding).csv(path, sep="\u0001", quote="")
        if lines.where(F.contains("_c0", F.lit("\ufffd"))).isEmpty():
            return encoding
    return ENCODINGS[-1]


def read_csv(spark: SparkSession, reference: object, *, limit: int = 0, encoding: str | None = None, split: bool | None = None) -> DataFrame:
    """All columns as strings; texts that mean missing become null.

    Without ``encoding`` the first one that fits is taken.  ``limit`` keeps
    the first rows of a sample run; 0 keeps all.  Quoted fields may hold line
    ends: files that fit one task are read by one, larger ones (or all, by
    ``split``) are cut into records by many, with the same rows.
    """
    path = resolve_reference(reference)
    encoding = encoding or valid_encoding(spark, path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    if split is None:
        split = split_csv.largest(spark, path) > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if split:
        names = spark.read.option("header", True).option("escape", '"').option("encoding", encoding).csv(path).columns
        raw = split_csv.parsed(spark, path, names, encoding)
    else:
        raw = reader.csv(path)
    own = lambda c: F.col("`" + c.replace("`", "``") + "`")
    raw = raw.select(*[F.when(~F.trim(own(c)).isin(*MISSING), own(c)).alias(c.lstrip("\ufeff")) for c in raw.columns])
    return limited(raw, limit)


def limited(df: DataFrame, limit: int) -> DataFrame:
    return df.limit(limit) if limit > 0 else df


def read_header(spark: SparkSession, reference: object) -> list[str]:
    """Column names from the first line only."""
    path = resolve_reference(reference)
    for encoding in ENCODINGS:
        found = spark.read.option("encoding", encoding).csv(path, sep="\u0001", quote="").limit(1).first()
        if found is None:
            return []
        line = (found[0] or "").lstrip("\ufeff")
        if "\ufffd" not in line:
            break
    return next(csv.reader([line]))


def read_pairs(spark: SparkSession, reference: object) -> DataFrame:
    """Labeled pairs with the columns of both sides as ``l_x`` and ``r_x``."""
    return sided(read_csv(spark, reference))


def sided(df: DataFrame) -> DataFrame:
    """Columns that a prefix assigns to a side, as ``l_x`` and ``r_x``."""
    out = {}
    for c in df.columns:
        low = c.strip().lower()
        side = "l_" if low.startswith(("table1.", "ltable_", "left_")) else "r_" if low.startswith(("table2.", "rtable_", "right_")) else ""
        out[c] = side + field_name(c)
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in out.items()])


def reference_pairs(rows: DataFrame) -> DataFrame:
    """(entity_id, ref, title) of a reference master with source_A_id and source_B_id."""
    own = lambda c, n: F.when(F.trim(c) != "", F.concat(F.lit(n), F.trim(c)))
    refs = F.array(own("source_A_id", "table1:"), own("source_B_id", "table2:"))
    return rows.select("entity_id", "title", F.explode(F.filter(refs, lambda r: r.isNotNull())).alias("ref"))


def master_scan(entities: DataFrame, golden: DataFrame) -> DataFrame:
    """The master as a table to match against: entities, or the golden records where there are none; ids as ``entity:<id>``."""
    row = lambda df, title: df.select(F.concat(F.lit("entity:"), F.col("entity_id").cast("string")).alias("id"), F.col(title).alias("title"), "manufacturer", F.col("price").cast("string").alias("price"))
    return row(golden, "title") if entities.isEmpty() else row(entities, "canonical_title")


def discover_datasets(spark: SparkSession, root: str) -> list[str]:
    """Folders under ``root`` that hold tableA.csv and tableB.csv, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    has = lambda folder, name: fs.exists(jvm.org.apache.hadoop.fs.Path(folder, name))
    found = [x.getPath() for x in fs.listStatus(path) if x.isDirectory()]
    return sorted(str(p.toString()) for p in found if has(p, "tableA.csv") and has(p, "tableB.csv"))


def latest_run(runs: DataFrame) -> DataFrame:
    """Of each run the payload that was written last, and of all runs the last one with a valid payload."""
    last = runs.groupBy("run_id").agg(F.max_by("payload", "updated_at").alias("payload"), F.max("updated_at").alias("updated_at"))
    return last.where(is_json(F.col("payload"))).orderBy(F.desc("updated_at"), F.desc("run_id")).limit(1)


def latest_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified, text) of JSON reports, the latest first; unreadable ones are left out."""
    files = spark.read.format("binaryFile").load(pattern)
    out = files.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    return out.where(is_json(F.col("text"))).orderBy(F.desc("modified"), F.desc("path"))


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, *, mark: bool = False) -> None:
    """CSV with a header; with ``fields`` just these, missing ones empty, and with ``mark`` behind a byte order mark."""
    if fields is not None:
        df = df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit("")).alias(c) for c in fields])
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(report: DataFrame, mismatches: DataFrame, path: str) -> None:
    """The measures of a comparison as JSON and the clusters that differ as CSV below ``path``."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    write_csv(mismatches, f"{path}/mismatches", ["side", "refs", "reference_title", "predicted_entity_id", "predicted_title"], mark=True)
