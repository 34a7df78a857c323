"""Records of large CSV files whose quoted fields may hold line ends, cut by many tasks.

Whether a line begins inside a quoted field depends on all lines before it.
So each split first tells in which state it ends for both states that it may
begin in; put one after the other, these give each split's true first state,
and all splits then cut their records at the same time.  Only what lies
across splits, a piece at either end of each, is joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, TAIL = 0, 1, 2


def stays_open(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of ``line``, which begins inside one or at a field's start.

    A quote opens a field only as its first character; two in a row are one character of it.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            while at >= 0 and line.startswith('""', at):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            inside, at = False, at + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    raw = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(split, first row, end) of the rows of each split, which follow one another."""
    file, start = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
    code = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cut = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cut], [*cut, len(start)], strict=True):
        if b > a:
            yield (file[int(a)].as_py(), int(start[a])), int(a), int(b)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: is it open at its end if it begins outside, and if it begins inside, and does its first line end in a carriage return."""
    states: dict[tuple[str, int], list[bool]] = {}
    returns: dict[tuple[str, int], bool] = {}
    for batch in batches:
        quoted = pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False)
        for split, a, b in _runs(batch):
            state = states.setdefault(split, [False, True])
            returns.setdefault(split, batch.column(2)[a].as_py().endswith("\r"))
            for k in np.flatnonzero(quoted[a:b]) + a:
                line = batch.column(2)[int(k)].as_py()
                state[:] = [stays_open(line, s) for s in state] if state[0] != state[1] else [stays_open(line, state[0])] * 2
    rows = [(*split, *state, returns[split]) for split, state in states.items()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "start", "out", "inn", "returns"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, kind, first, text): whole records, and the pieces at either end of a split; ``first`` marks the first record of a file."""
    split, held, kind, first = None, [], WHOLE, False

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "start", "kind", "first", "text"])

    for batch in batches:
        rows: list[tuple] = []
        quoted = pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False)
        lines = batch.column(2).to_pylist()
        for own, a, b in _runs(batch):
            if own != split:
                if held:
                    rows.append((*split, TAIL if kind == WHOLE else HEAD, first, "\n".join(held)))
                split, held, first = own, [], own[1] == 0
                kind = HEAD if batch.column(3)[a].as_py() else WHOLE
                inside = kind == HEAD
            for k in range(a, b):
                inside = stays_open(lines[k], inside) if quoted[k] else inside
                held.append(lines[k])
                if not inside:
                    rows.append((*split, kind, first, "\n".join(held)))
                    held, kind, first = [], WHOLE, False
        yield made(rows)
    if held:
        yield made([(*split, TAIL if kind == WHOLE else HEAD, first, "\n".join(held))])


def largest(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file of a path, folder or pattern; 0 without any."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    sizes = [0]
    for found in fs.globStatus(at) or []:
        inner = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
        sizes += [x.getLen() for x in inner]
    return max(sizes)


def records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(first, text): the records of the files of ``path``; ``first`` marks the first one of a file, its header.

    In files whose first line ends in a carriage return and a line feed these
    two count as a line end everywhere.
    """
    lines = _lines(spark, path, encoding)
    ends = lines.mapInArrow(_ends, "file string, start long, out boolean, inn boolean, returns boolean")
    # One row for each split, as the driver lists them anyway; a split of several tasks does not occur.
    state, begun, returns = {}, [], set()
    for r in sorted(ends.collect(), key=lambda r: (r.file, r.start)):
        begun.append((r.file, r.start, state.get(r.file, False)))
        if r.start == 0 and r.returns:
            returns.add(r.file)
        state[r.file] = r.inn if state.get(r.file, False) else r.out
    opened = spark.createDataFrame([x[:2] for x in begun if x[2]], "file string, start long").withColumn("open", F.lit(True))
    told = lines.join(F.broadcast(opened), ["file", "start"], "left").select("file", "start", "value", F.coalesce("open", F.lit(False)).alias("open"))
    cut = told.mapInArrow(_cut, "file string, start long, kind int, first boolean, text string")
    pieces = cut.where(F.col("kind") != WHOLE)
    # A piece at a split's end begins a record, and all pieces at later splits' starts up to the next such one belong to it.
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = pieces.withColumn("n", F.sum((F.col("kind") == TAIL).cast("int")).over(order)).groupBy("file", "n").agg(
        F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("p")
    )
    whole = joined.select("file", "first", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    every = cut.where(F.col("kind") == WHOLE).select("file", "first", "text").unionByName(whole)
    marked = spark.createDataFrame([(f,) for f in sorted(returns)], "file string").withColumn("returns", F.lit(True))
    text = F.when(F.col("returns"), F.regexp_replace(F.regexp_replace("text", r"\r$", ""), "\r\n", "\n")).otherwise(F.col("text"))
    return every.join(F.broadcast(marked), "file", "left").select("first", text.alias("text"))


def parsed(spark: SparkSession, path: str, names: list[str], encoding: str = "UTF-8") -> DataFrame:
    """The records as columns of strings, without headers and empty lines."""
    own = records(spark, path, encoding).where(~F.col("first")).select("text").where("text not in ('', '\r')")
    shape = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return own.select(F.from_csv("text", shape, {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
