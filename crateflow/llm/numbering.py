"""Gapless numbers over any number of rows: no task holds a group, and the driver holds a count per piece only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateflow.llm.runtime import write_table

PIECE, PLACE, TIE = "__piece", "__place", "__tie"


def numbered(rows: DataFrame, order: Sequence[Column], name: str, by: str | None = None) -> DataFrame:
    """rows with `name` (long): 0, 1, 2, ... in the order given, within each value of `by` if asked.

    rows: a written table, so that reading it again gives the same rows in the same files; rows that are equal under the
    order are numbered as they lie there. by: an integer column without nulls. No column begins with two underscores.
    Rows are dealt by range of (by, order), a task numbers what it holds, and the counts of all pieces give each piece its
    first number. A piece holds several values of `by` or a value fills several pieces; both together are at most the number
    of shuffle partitions and of values of `by`, which bounds the counts that the driver adds up and sends back.
    """
    keys = [*([F.col(by)] if by else []), *order, F.col(TIE)]
    dealt = rows.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(TIE)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            group = batch.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(size, np.int64)
            at = np.arange(size)
            first = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
            places = at - first
            if group[0] == last:
                places[first == 0] += n
            last, n = group[-1], int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(size, piece, np.int32)), pa.array(places.astype(np.int64))], names=[*batch.schema.names, PIECE, PLACE])

    schema = T.StructType([*rows.schema.fields, T.StructField(PIECE, T.IntegerType()), T.StructField(PLACE, T.LongType())])
    placed, _ = write_table(dealt.mapInArrow(place, schema))
    group = F.col(by).cast("long") if by else F.lit(0).cast("long")
    counts = placed.groupBy(group.alias("g"), PIECE).agg(F.count("*").alias("n")).collect()
    first: list[tuple[int, int, int]] = []
    last, upto = None, 0
    for g, piece, n in sorted(map(tuple, counts)):
        upto = upto if g == last else 0
        first.append((g, piece, upto))
        last, upto = g, upto + n
    starts = rows.sparkSession.createDataFrame(first, f"__g long, {PIECE} int, __first long")
    joined = placed.withColumn("__g", group).join(F.broadcast(starts), ["__g", PIECE])
    return joined.select(*rows.columns, (F.col("__first") + F.col(PLACE)).alias(name))
