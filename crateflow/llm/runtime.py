"""What several operators share: durable intermediate tables, bounded text blocks and column checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds as numpy arrays at a time; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Python workers get some megabytes of rows at a time, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset one machine alone may take its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or os.path.join("/tmp/checkpoints", f"{os.path.basename(tempfile.gettempdir())}-{os.getuid()}")


def with_results(docs: DataFrame, result: Column, fields: Mapping[str, str]) -> DataFrame:
    """docs with columns from the fields of a struct: name of the column to field. Rows are carried whole, so no name clashes."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), result.alias("result"))
    new = {name: F.col("result").getField(field).alias(name) for name, field in fields.items()}
    return packed.select(*[new.pop(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns], *new.values())


def write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: the lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    return write_table(df)[0]


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table of write_table() that nothing reads any more (loops use this to keep the disk bounded)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bucket_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit("")).cast("string")) % modulus


def text_blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have limit bytes together at most, or one row."""
    lengths = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    first, held = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > first and held + n > limit:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


class KeyCounts:
    """Counts of 64-bit keys over the blocks of one task, in bounded memory: merged when many, given out when still many.

    Each key has `width` counts. add() takes keys with repetition; flush() gives (keys, counts) without.
    """

    def __init__(self, width: int, limit: int = 1 << 21):
        self.width, self.limit = width, limit
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if len(keys):
            self.parts.append(_summed(keys, counts))
            self.held += len(self.parts[-1][0])
        if self.held > self.limit and len(self.parts) > 1:
            self._merge()

    def full(self) -> bool:
        """Whether even without repetition many are held; _merge() is done where this can be."""
        return self.held > self.limit // 2 and len(self.parts) == 1

    def _merge(self) -> None:
        self.parts = [_summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))]
        self.held = len(self.parts[0][0])

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self._merge()
        out = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros((0, self.width), np.int64))
        self.parts, self.held = [], 0
        return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first, axis=0)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.diff(np.append(first, len(values)))
