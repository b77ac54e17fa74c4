"""Near-duplicate embeddings with a forest of random-projection trees, verified by cosine in double precision.

1. Equal vectors of a label are one class.
2. Every tree splits the classes recursively: a node projects onto its level's random direction and parts at the median
   of the sample's projections (where few of the sample arrive, at the level's). Vectors within the spill margin of a
   split go down both ways, so near vectors seldom part in every tree. The depth follows the number of classes. The
   sample only shapes the trees; every class goes down all of them.
3. The classes of a label and leaf are compared with each other, by products of blocks of bounded size. A class's vector
   moves once for each of its leaves; the leaves of linked classes are found anew where they meet. A pair that shares
   several leaves counts in the smallest shared one only. A group gives one row per class: its verified links, and
   its root among them.
4. The connected components of (class, root) are the near-duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.components import components
from crateflow.llm.runtime import durable

THRESHOLD, TREES, LEAF, SAMPLE = 0.98, 6, 256, 16_384
#: A pair at the threshold differs by sqrt(2 - 2 * threshold) in length; the margin is SPILL times what a direction sees of it.
SPILL = 0.5
#: A split wants so many of the sample for a median of its own.
LEAST_SAMPLE = 32
BLOCK = 512
_SEED = 48_611


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    c = F.col(vector)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & F.coalesce(fine & F.exists(c, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Forest:
    directions: np.ndarray  # trees, levels, dimensions
    medians: np.ndarray  # trees, levels: of the whole sample
    splits: list[list[np.ndarray]]  # per tree and level: a node's own median, or nan
    margin: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors; leaves of different trees differ."""
        rows_, leaves = [], []
        for t in range(self.directions.shape[0]):
            rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.directions.shape[1]):
                split = np.full(len(rows), self.medians[t, level])
                if level < len(self.splits[t]):
                    own = self.splits[t][level][node]
                    split = np.where(np.isnan(own), split, own)
                off = (x @ self.directions[t, level])[rows] - split
                low, high = off <= self.margin, off > -self.margin
                rows, node = np.concatenate([rows[low], rows[high]]), np.concatenate([node[low] * 2, node[high] * 2 + 1])
            rows_.append(rows)
            leaves.append(node + (np.int64(t + 1) << 48))
        return np.concatenate(rows_), np.concatenate(leaves)


def grow(sample: np.ndarray, depth: int, trees: int, threshold: float, spill: float) -> Forest:
    """Trees of this depth, from unit vectors (n, dimensions)."""
    rng = np.random.default_rng(_SEED)
    dim = max(1, sample.shape[1])
    directions = rng.standard_normal((trees, depth, dim))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    medians, splits = np.zeros((trees, depth)), []
    for t in range(trees):
        node, own = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            p = sample @ directions[t, level]
            medians[t, level] = np.median(p) if len(p) else 0.0
            if len(sample) >> level >= LEAST_SAMPLE:
                order = np.lexsort((p, node))
                counts = np.bincount(node, minlength=1 << level)
                first = np.concatenate(([0], np.cumsum(counts)[:-1]))
                middle = np.where(counts > 0, p[order][np.minimum(first + counts // 2, len(p) - 1)], np.nan)
                own.append(np.where(counts >= LEAST_SAMPLE, middle, np.nan))
                split = np.where(np.isnan(own[-1][node]), medians[t, level], own[-1][node])
            else:
                split = medians[t, level]
            node = node * 2 + (p > split)
        splits.append(own)
    return Forest(directions, medians, splits, spill * math.sqrt(max(0.0, 2 - 2 * threshold) / dim))


def _unit(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    big = np.abs(out).max(axis=1, keepdims=True)
    out /= np.where(big > 0, big, 1)  # so that squares neither vanish nor overflow
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _pairs(left: np.ndarray, right: np.ndarray, same: bool, leaf: int, forest: Forest, threshold: float) -> list[tuple[int, int]]:
    """Index pairs of unit vectors at the threshold whose smallest shared leaf this is."""
    near = left @ right.T >= threshold
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    if not len(i):
        return []
    a, b = _lists(left, np.unique(i), leaf, forest, -1), _lists(right, np.unique(j), leaf, forest, -2)
    first = np.ones(len(i), bool)
    for lo in range(0, len(i), 4096):
        p, q = a[i[lo : lo + 4096]], b[j[lo : lo + 4096]]
        first[lo : lo + 4096] = ~(p[:, :, None] == q[:, None, :]).any(axis=(1, 2))
    return list(zip(i[first].tolist(), j[first].tolist(), strict=True))


def _lists(units: np.ndarray, wanted: np.ndarray, leaf: int, forest: Forest, pad: int) -> np.ndarray:
    """For each of the vectors its leaves below `leaf`, as rows padded with pad; only the wanted ones are found."""
    row, leaves = forest.leaves(units[wanted])
    row, leaves = row[leaves < leaf], leaves[leaves < leaf]
    order = np.argsort(row, kind="stable")
    row, leaves = row[order], leaves[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full((len(units), int(place.max(initial=0)) + 1), pad, np.int64)
    out[wanted[row], place] = leaves
    return out


def near_duplicates(rows: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", threshold: float = THRESHOLD, trees: int = TREES, leaf_size: int = LEAF, spill: float = SPILL) -> DataFrame:
    """A row per input row: vec_id, n_links, component_id and kept.

    Rows are compared if their labels are equal and not null and their vectors have equally many components. n_links:
    the other rows linked directly; component_id: the smallest vec_id reachable by links; kept: whether that is the
    row's own. Unusable vectors (null, zero, with null or non-finite components) link with nothing, not even with their
    own repetition. Equal vectors link with each other; repeated rows are such. Vectors that are multiples of each
    other link too. Null ids are larger than all others; an empty table gives an empty table.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    good = kept.where(usable("v") & F.col("label").isNotNull())
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = durable(durable(classes).withColumn("cls", F.monotonically_increasing_id()))  # written, so the numbers stay
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim")).first()
    sample = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["v"].tolist()
    depth = max(0, math.ceil(math.log2(max(1, size["n"] / leaf_size))))
    forest = spark.sparkContext.broadcast(grow(_unit(sample, size["dim"]), depth, trees, threshold, spill))  # grows with the bounded sample and the depth
    dim = size["dim"]

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                vectors = part.column(3).to_pylist()
                row, leaf = forest.value.leaves(_unit(vectors, dim))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                starts = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(leaf))
                sizes, packed = pa.array([len(v) for v in vectors], pa.int32()), pa.array([np.array(v, kind).tobytes() for v in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, part.column(2), packed, lists], ["label", "cls", "dim", "weight", "x", "leaves"])

    kind = np.float32 if classes.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    down = durable(classes.select("label", "cls", "weight", "v").mapInArrow(descend, f"label string, cls long, dim int, weight long, x binary, leaves array<long>"))
    # which leaves are large is found and told to the classes without their vectors
    spots = down.select("label", "dim", "cls", F.explode("leaves").alias("leaf"))
    large = spots.groupBy("label", "dim", "leaf").count().where(F.col("count") > BLOCK).select("label", "dim", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    told = spots.join(large, ["label", "dim", "leaf"]).groupBy(F.col("cls").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("leaf", "blocks"))).alias("told"))
    placed = down.join(told, F.col("cls") == F.col("c"), "left").select("label", "dim", "cls", "weight", "x", "told", F.explode("leaves").alias("leaf"))
    placed = placed.withColumn("blocks", F.coalesce(F.col("told")[F.col("leaf")], F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("cls", "leaf"), F.col("blocks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("blk", k).alias("bi"), F.greatest("blk", k).alias("bj")))
    dealt = placed.select("label", "dim", "leaf", F.explode(both).alias("pair"), "blk", "cls", "weight", "x")
    dealt = dealt.select("label", "dim", "leaf", "pair.bi", "pair.bj", "blk", "cls", "weight", "x").repartition("label", "dim", "leaf", "bi", "bj").sortWithinPartitions("label", "dim", "leaf", "bi", "bj")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out: list[tuple[int, int, int]] = []
        for (_, _, leaf, bi, bj), members in groupby(stream, key=lambda r: r[:5]):
            held = list(members)
            units = _unit([np.frombuffer(m[8], kind) for m in held], dim)
            left, right = ([k for k, m in enumerate(held) if m[5] == side] for side in (bi, bj))
            if not left or not right:
                continue
            found, root = {}, {}

            def top(x: int, root=root) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in _pairs(units[left], units[right], bi == bj, leaf, forest.value, threshold):
                x, y = held[left[i]], held[right[j]]
                found[x[6]] = found.get(x[6], 0) + y[7]
                found[y[6]] = found.get(y[6], 0) + x[7]
                p, q = sorted((top(x[6]), top(y[6])))
                root[q] = p
            out.extend((x, n, top(x)) for x, n in found.items())
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cls", "links", "root"])

    found = durable(dealt.mapInArrow(compare, "cls long, links long, root long"))
    groups = components(found.where("root <> cls").select(F.col("cls").alias("u"), F.col("root").alias("v")))
    links = found.groupBy(F.col("cls").alias("c")).agg(F.sum("links").alias("links"))
    named = classes.select("label", "v", "cls", "rep", "weight").join(groups, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy(F.col("component").alias("m")).agg(F.min("rep").alias("component_id"))
    verdict = named.join(least, F.col("component") == F.col("m")).join(links, F.col("cls") == F.col("c"), "left")
    verdict = durable(verdict.select(F.col("label").alias("l"), F.col("v").alias("w"), "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n")))
    marked = kept.withColumn("fine", usable("v") & F.col("label").isNotNull())
    out = marked.join(verdict, F.col("fine") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
