"""Places within sorted groups, and what stands at a place: no task holds a group, however large."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateflow.sources.tables import written

_PIECE, _PLACE = "__piece", "__place"


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls equal each other."""
    a, b = column[1:], column[:-1]
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str, name: str = "place") -> DataFrame:
    """rows with `name` (long): the sum of `weight` over the rows before in the group of `by` (any columns, nulls are a group).

    rows: distinct in (by, order). They are dealt by range of these, so a group of any size fills as many tasks as it
    needs; each task counts on from where its group began there. Only groups that go on from one task into the next
    need the sums of the tasks before, and a task's end cuts one group, so these are no more than tasks: that is the size
    of what is broadcast.
    """
    keys = [*map(F.col, by), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            columns, weights = [batch.column(c) for c in by], batch.column(weight).to_numpy(zero_copy_only=False)
            starts = np.ones(size, bool)
            if size > 1:
                starts[1:] = np.any([_changes(c) for c in columns], axis=0) if columns else False
            first = np.maximum.accumulate(np.where(starts, np.arange(size), 0))
            before = np.cumsum(weights) - weights
            places, head = before - before[first], tuple(c[0].as_py() for c in columns)
            if head == last:
                places[first == 0] += n
            last, n = tuple(c[-1].as_py() for c in columns), int(places[-1] + weights[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(size, piece, np.int32)), pa.array(places.astype(np.int64))], names=[*batch.schema.names, _PIECE, _PLACE])

    table = written(dealt.mapInArrow(number, T.StructType([*rows.schema.fields, T.StructField(_PIECE, T.IntegerType()), T.StructField(_PLACE, T.LongType())])))
    ends = table.groupBy(*by, _PIECE).agg(F.sum(weight).alias("__n"))
    among = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(among.orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1))
    cut = ends.withColumn("__before", before).where(F.col("__before").isNotNull())
    later = cut.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col(_PIECE).alias("__at"), "__before")
    same = F.col(_PIECE) == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return table.join(F.broadcast(later), same, "left").select(*rows.columns, (F.col(_PLACE) + F.coalesce("__before", F.lit(0))).alias(name))


def values_at(rows: DataFrame, by: Sequence[str], value: str, places: Mapping[str, Column]) -> DataFrame:
    """Per group the values at some places of its sorted values. places: name to a place from 0, an expression of n, the group's size.

    Equal values are counted before anything is dealt, so neither a group nor a value with a third of all rows is one task's.
    Nulls don't count. A group whose places are out of its range has nulls there; one without values has no row.
    """
    held = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("w"))
    at = placed(held, by, [F.col(value)], "w")
    among = [F.col(c).alias(f"__n_{c}") for c in by]
    sizes = at.groupBy(*among).agg(F.sum("w").alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__n_{c}"))
    sized = at.join(sizes, same)
    hits = {name: F.coalesce(F.col("place") <= p.cast("long"), F.lit(False)) & (p.cast("long") < F.col("place") + F.col("w")) for name, p in places.items()}
    any_hit = F.col("place") == 0
    for hit in hits.values():
        any_hit = any_hit | hit
    return sized.where(any_hit).groupBy(*by).agg(*[F.max(F.when(hit, F.col(value))).alias(name) for name, hit in hits.items()])


def medians(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Exact medians (the mean of the middle two for even counts) as F.median gives them, for groups that no task could hold."""
    n = F.col("n")
    middle = values_at(rows, by, value, {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)})
    return middle.select(*by, ((F.col("low").cast("double") + F.col("high").cast("double")) / 2).alias("median"))


def p95s(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """numeric.p95() of each group."""
    return values_at(rows, by, value, {"p95": F.greatest(F.lit(0), F.floor(F.col("n") * 0.95) - 1)})
