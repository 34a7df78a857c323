"""A Bloom filter over 64-bit values, to drop rows before a shuffle.

It has sixteen bits or more for a value, from ``2**LEAST`` bits up to
``2**MOST`` (32 MB), so it may be broadcast; beyond that a larger input only
makes it pass more rows, which the join behind it drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.llm.durable import durable, forget
from goldweave.llm.words import U, splitmix

LEAST, MOST = 20, 28
#: Partitions in which a filter comes to the driver.
ASKED = 8
#: Bits of one row that comes to the driver.
_CELL = 1 << 12
#: Makes the places in a second filter independent of those in the first.
_OTHER = 0x5851F42D4C957F2D


def _bits(values: np.ndarray, size: int) -> np.ndarray:
    return splitmix(values.astype(np.int64).view(U)) >> U(64 - size)


def _cells(size: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_bits(batch.column(0).to_numpy(), size))
            if not len(bit):
                continue
            cell = (bit >> U(6)).astype(np.int32)
            first = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1))
            bits = np.bitwise_or.reduceat(U(1) << (bit & U(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(bits.view(np.int64))], ["cell", "bits"])

    return cells


def build(values: DataFrame, count: int) -> bytes:
    """The filter over the single long column of ``values``, about ``count`` without nulls.

    Words of 64 bits meet by their place and then join to cells, so that at
    most 2**(MOST - 12) rows of at most 512 bytes come to the driver.
    """
    size = min(max(LEAST, (16 * max(count, 1)).bit_length()), MOST)
    words = values.mapInArrow(_cells(size), "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary()), pa.array([batch.column(1).to_numpy().tobytes()], pa.binary())], ["cells", "bits"])

    table = np.zeros(1 << (size - 6), dtype=np.int64)
    # The driver asks for one partition after the other, each by a job of its own: few of them.
    for row in words.mapInArrow(joined, "cells binary, bits binary").coalesce(ASKED).toLocalIterator(prefetchPartitions=True):
        table[np.frombuffer(row["cells"], dtype=np.int32)] = np.frombuffer(row["bits"], dtype=np.int64)
    return table.tobytes()


def may_hold(table: bytes, values: np.ndarray) -> np.ndarray:
    """A mask of the values that may be in the filter."""
    words, bit = np.frombuffer(table, dtype=U), _bits(values, len(table).bit_length() + 2)
    return (words[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1


def rows_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts(id, text)`` whose id may be in the single long column of ``ids``; the join behind it drops the rest.

    Of rows that repeat an id and a text a task gives one, so that a row that
    is repeated without end does not meet in one place.
    """
    table = texts.sparkSession.sparkContext.broadcast(build(ids, ids.count()))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            may = may_hold(table.value, batch.column(0).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(may))
            new = []
            for row in zip(batch.column(0).to_pylist(), map(hash, batch.column(1).to_pylist()), strict=True):
                new.append(row not in seen)
                seen.add(row)
            yield batch if all(new) else batch.filter(pa.array(new))

    return texts.where(F.col(texts.columns[0]).isNotNull()).mapInArrow(kept, texts.schema)


def _held(table: object, mask: int = 0):
    @F.arrow_udf("boolean")
    def held(ids: pa.Array) -> pa.Array:
        return pa.array(may_hold(table.value, ids.fill_null(0).to_numpy(zero_copy_only=False) ^ np.int64(mask)))

    return held


def rows_in(rows: DataFrame, own: Column, ids: DataFrame) -> DataFrame:
    """``rows`` whose id ``own`` is in the single long column of ``ids``; few others are shuffled."""
    table = rows.sparkSession.sparkContext.broadcast(build(ids, ids.count()))
    return rows.where(own.isNotNull() & _held(table)(own)).join(ids.toDF("__own_id").hint("merge"), own == F.col("__own_id"), "left_semi")


def rows_without(rows: DataFrame, own: Column, ids: DataFrame, others: DataFrame) -> DataFrame:
    """``rows`` whose id ``own`` is null or not in ``ids``; ``others`` holds all ids that are not, each a single long column.

    One filter holds ``ids``, a second one those of ``others`` that pass the
    first.  Rows outside the first stay and rows outside the second go where
    they are read; only rows in both, a few in a hundred, are shuffled to meet
    the ids of ``others``.
    """
    spark, name = rows.sparkSession, others.columns[0]
    first = _held(spark.sparkContext.broadcast(build(ids, ids.count())))
    passed = durable(others.where(first(F.col(name))), "passed")
    left = rows.where(own.isNull() | ~first(own))
    count = passed.count()
    if not count:
        forget(passed)
        return left
    second = _held(spark.sparkContext.broadcast(build(passed.select(F.col(name).bitwiseXOR(F.lit(_OTHER))), count)), _OTHER)
    open_rows = rows.where(own.isNotNull() & first(own) & second(own))
    return left.union(open_rows.join(passed.toDF("__own_id").hint("merge"), own == F.col("__own_id"), "left_semi"))


def of_ids(texts: DataFrame, ids: DataFrame, make, schema: str) -> DataFrame:
    """``make(texts)`` (a bytes value for each text) of those rows of ``texts(id, text)`` whose id is in ``ids``.

    The filter drops most other rows where they are read, so that neither their
    texts nor their values are shuffled.
    """
    name = ids.columns[0]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(make(batch.column(1).to_pylist()), pa.binary())], [name, "own"])

    return rows_of(texts, ids).mapInArrow(made, schema).join(ids, name, "left_semi")
