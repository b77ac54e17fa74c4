"""Importance resampling towards a target: hashed n-gram counts in two passes, Gumbel scores, the best share drawn."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.numbering import numbered
from crateflow.llm.runtime import durable, text_blocks
from crateflow.llm.words import BEYOND, DIGITS, LOWER, folding, parts

WORDS = folding(LOWER + DIGITS + BEYOND)
#: Words whose buckets a task remembers.
REMEMBERED = 1 << 17


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    longest: int = 1
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


class _Buckets(dict):
    """The bucket of a feature's bytes, remembered while there is room."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def features(text: bytes, longest: int, bucket: _Buckets) -> tuple[list[np.ndarray], int]:
    """The buckets of all runs of 1 to `longest` words of a text, in pieces, and the number of its words."""
    found: list[np.ndarray] = []
    before: list[bytes] = []
    n = 0
    for words in parts(text, WORDS):
        n += len(words)
        found.append(np.fromiter(map(bucket.__getitem__, words), np.int32, len(words)))
        for size in range(2, longest + 1):
            line = before[len(before) - min(size - 1, len(before)):] + words
            runs = [b" ".join(line[k : k + size]) for k in range(len(line) - size + 1)]
            found.append(np.fromiter(map(bucket.__getitem__, runs), np.int32, len(runs)))
        before = (before + words)[-(longest - 1):] if longest > 1 else []
    return found, n


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, settings: Settings, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket: a vector per partition, merged in a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket = np.zeros(settings.buckets, np.int64), _Buckets(settings.buckets)
        for batch in batches:
            for lo, hi in text_blocks(batch, 0):
                for t in _bytes(batch.column(0).slice(lo, hi - lo)):
                    for some in features(t, settings.longest, bucket)[0]:
                        total += np.bincount(some, minlength=settings.buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select(F.col(f"`{text}`")).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(settings.buckets, np.int64)
    return vectors.map(lambda row: np.frombuffer(row[0], np.int64)).treeReduce(np.add, depth=3)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's floored thousandfold log ratio of its smoothed share in the target to that in the corpus."""
    n = len(corpus)
    s, t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, settings: Settings, id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row its id, n_features, n_words and weight, the floored mean gain of its features; carried: a struct of other columns."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, worth = _Buckets(settings.buckets), sent.value
        for batch in batches:
            for lo, hi in text_blocks(batch, 0):
                found = [features(t, settings.longest, bucket) for t in _bytes(batch.column(0).slice(lo, hi - lo))]
                sizes = np.array([sum(map(len, some)) for some, _ in found], np.int64)
                joined = np.concatenate([np.zeros(0, np.int32), *(x for some, _ in found for x in some)])
                of = np.repeat(np.arange(hi - lo), sizes)
                # sums of whole numbers below 2^53 are exact in doubles
                sums = np.bincount(of, weights=worth[joined], minlength=hi - lo).astype(np.int64)
                weight = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
                columns = [pa.array(x) for x in (sizes, np.array([n for _, n in found], np.int64), weight)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), *columns], names=[*batch.schema.names[1:], "n_features", "n_words", "weight"])

    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    picked = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{id}`").alias("doc_id"), *rest)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(weigh, f"{head}, n_features long, n_words long, weight long")


def gumbel(id: Column, seed: int) -> Column:
    """A floored thousandfold Gumbel draw from the id's hash; a null id counts as the empty text."""
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(mark, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def _threshold(counts: list[tuple[int, int]], k: int) -> int | None:
    """The k-th highest score; None if there is nothing to draw."""
    for score, n in sorted(counts, reverse=True):
        k -= n
        if k <= 0:
            return score
    return None


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank 1, 2, 3, ... of the rows drawn, else null.

    Drawn are floor(percent N / 100) of the N rows with at least least_words words, the highest scores first, ties to the
    smaller id (nulls last), then as the rows lie. Two passes read the texts: the first leaves `buckets` numbers a task, the second
    gathers the gains of all buckets, which are sent to every task. Scores are whole numbers within some hundred thousand
    (gains of 64-bit counts, Gumbel draws of 32-bit hashes), so the driver finds the lowest drawn score from a count per
    score; only rows from there on are put in order. Null and empty texts have no features and weight 0; repeated rows are rows of
    their own. Columns of docs other than id and text are not read unless carried, so their names cannot clash. An empty
    target or table is a count of nothing.
    """
    corpus, aim = bucket_counts(docs, settings, text), bucket_counts(target, settings, text)
    rows = weighed(docs, gains(corpus, aim), settings, id, text, carry)
    scored = durable(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), settings.seed)))
    able = F.col("n_words") >= settings.least_words
    counts = [tuple(r) for r in scored.where(able).groupBy("score").count().collect()]
    drawn = settings.percent * sum(n for _, n in counts) // 100
    least = _threshold(counts, drawn) if drawn else None
    out = [*[c for c in ("doc_id", "n_features", "weight", "score", "carried") if c in scored.columns]]
    if least is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    high = able & (F.col("score") >= least)
    ranked = numbered(scored.where(high), [F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return ranked.select(*out, rank.alias("rank")).unionByName(scored.where(~high).select(*out, F.lit(None).cast("long").alias("rank")))
