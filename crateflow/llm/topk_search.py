"""Exact top-k by inner product of integer vectors with MaxScore.

A component is a term, its value in a candidate the posting's impact. Candidates lie in shards of fixed size; near ones share
a shard, as a tree over a bounded sample splits them at medians. A shard keeps the bounds of each term and a ball around its
vectors.

1. Every query is searched in its own shard, where it lies as a candidate; its k-th best score there is its floor.
2. A query goes on to those shards whose bounds reach its floor: the sum of the largest products of all terms, and the ball's.
   Queries move, in blocks, and shards stay.
3. Within a piece of a shard a query's terms are in order of their gain. The smallest ones whose bound stays below the
   floor are non-essential. The postings of the essential terms alone are traversed; a candidate is probed
   for the others only while what it has and the bound of those left reach the floor. A query with most of its terms
   essential traverses all of them at once, by a product of blocks.
4. The shards' results, k a query and shard at most, are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.llm.runtime import durable

#: A floor below all scores, and the size from which doubles don't hold every whole number.
LOWEST, EXACT = np.iinfo(np.int64).min, 1 << 53
#: Queries searched at a time, candidates of a shard and of a piece, shards' bounds that move together.
QUERY_BLOCK, SHARD, PIECE, RUN = 512, 4096, 2048, 256
#: Queries that meet the shards' bounds together.
GROUP = 1 << 15
#: The tree's sample and the least of it that a split wants.
SAMPLE, LEAST_SAMPLE = 16_384, 64


def quantised(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector is null or has null or non-finite components."""
    c = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & fine, F.transform(c, lambda x: F.floor(x * scale).cast("long")))


class Block:
    """Queries with their best k so far, or with floors that their results must reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.whole, self.k = ids, vectors.astype(np.int64), k
        self.q = self.whole.astype(float)
        self.short = self.q.astype(np.float32)
        self.limit = int(np.abs(self.whole).max(initial=0)) * self.q.shape[1]
        self.at, self.score, self.cand = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(len(ids), LOWEST) if floors is None else floors.copy()
        self.traversed = self.probed = 0

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """A piece of a shard: candidate ids and their vectors.

        Products are made in single or double precision where these hold all whole numbers here, else in 64-bit integers.
        """
        reach = self.limit * int(np.abs(x.astype(np.int64)).max(initial=0))
        if reach >= 1 << 63:
            raise OverflowError("scores of these vectors need more than 64 bits")
        query, x = (self.short, x.astype(np.float32)) if reach < 1 << 24 else (self.q, x.astype(float)) if reach < EXACT else (self.whole, x.astype(np.int64))
        norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        low, high = x.min(axis=0).astype(float), x.max(axis=0).astype(float)
        a, b = self.q * low, self.q * high
        most, gain = np.maximum(a, b), np.abs(b - a)
        order = np.argsort(gain, axis=1, kind="stable")
        # the bound of the 0, 1, 2, ... terms of least gain: by their largest products, and by their length times a candidate's
        ends = np.zeros((len(self.ids), 1))
        by_terms = np.concatenate([ends, np.cumsum(np.take_along_axis(most, order, axis=1), axis=1)], axis=1)
        length = np.sqrt(np.concatenate([ends, np.cumsum(np.take_along_axis(self.q**2, order, axis=1), axis=1)], axis=1))
        if reach >= EXACT:
            by_terms += reach * 1e-12  # what doubles may lose
        bound = np.minimum(by_terms, length * norms.max(initial=0) * (1 + 1e-9) + 1e-6)
        below = bound < self.floor[:, None]
        small = np.where(below.any(axis=1), below.shape[1] - 1 - np.argmax(below[:, ::-1], axis=1), 0)
        dim = self.q.shape[1]
        full = np.flatnonzero(2 * small < dim)  # most terms are essential
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(full):
            score = query[full] @ x.T
            self.traversed += dim * score.size
            self.probed += score.size
            i, j = np.nonzero(score >= self.floor[full, None])
            found.append((full[i], j, score[i, j].astype(np.int64)))
        postings = np.ascontiguousarray(x.T)
        for n in np.flatnonzero((2 * small >= dim) & (small < dim)):  # all terms non-essential: nothing here can compete
            rest, essential = order[n, : small[n]], order[n, small[n] :]
            partial = query[n, essential] @ postings[essential]
            self.traversed += len(essential) * len(partial)
            near = np.flatnonzero(partial + np.minimum(by_terms[n, small[n]], length[n, small[n]] * norms * (1 + 1e-9) + 1e-6) >= self.floor[n])
            score = partial[near] + x[near][:, rest] @ query[n, rest]
            self.probed += len(near)
            keep = score >= self.floor[n]
            found.append((np.full(int(keep.sum()), n), near[keep], score[keep].astype(np.int64)))
        if found:
            self._take(ids, *(np.concatenate(c) for c in zip(*found, strict=True)))

    def _take(self, ids: np.ndarray, at: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        other = self.ids[at] != ids[place]
        at, score, cand = np.concatenate([self.at, at[other]]), np.concatenate([self.score, score[other]]), np.concatenate([self.cand, ids[place[other]]])
        order = np.lexsort((cand, -score, at))
        at, score, cand = at[order], score[order], cand[order]
        first = np.searchsorted(at, np.arange(len(self.ids) + 1))
        place = np.arange(len(at)) - first[at]
        best = place < self.k
        self.at, self.score, self.cand = at[best], score[best], cand[best]
        last = place[best] == self.k - 1
        self.floor[self.at[last]] = np.maximum(self.floor[self.at[last]], self.score[last])

    def search(self, ids: np.ndarray, x: np.ndarray) -> Block:
        for lo in range(0, len(ids), PIECE):
            self.meet(ids[lo : lo + PIECE], x[lo : lo + PIECE])
        return self

    def results(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        return pa.array(self.ids[self.at]), pa.array(self.cand), pa.array(self.score)


@dataclass(frozen=True)
class Tree:
    """Splits by level: a node parts its vectors at a median of its widest component; a node of few of the sample doesn't part."""

    axes: list[np.ndarray]
    cuts: list[np.ndarray]

    @staticmethod
    def of(sample: np.ndarray, depth: int) -> Tree:
        node, axes, cuts = np.zeros(len(sample), np.int64), [], []
        for level in range(depth):
            axis, cut = np.zeros(1 << level, np.int64), np.full(1 << level, np.inf)
            for n in np.flatnonzero(np.bincount(node, minlength=1 << level) >= LEAST_SAMPLE):
                here = sample[node == n]
                axis[n] = int(np.argmax(here.std(axis=0)))
                cut[n] = np.median(here[:, axis[n]])
            axes.append(axis)
            cuts.append(cut)
            node = node * 2 + (sample[np.arange(len(sample)), axis[node]] > cut[node])
        return Tree(axes, cuts)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for axis, cut in zip(self.axes, self.cuts, strict=True):
            node = node * 2 + (x[np.arange(len(x)), axis[node]] > cut[node])
        return node


def _padded(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _batch(columns: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names.split())


def _shards(good: DataFrame, n: int, dim: int, kind: np.dtype) -> DataFrame:
    """(shard, ids, asks, x, low, high, center, radius): a row per shard, its vectors as bytes of `kind`."""
    depth = max(0, min(int(SAMPLE // LEAST_SAMPLE).bit_length() - 1, (n // SHARD).bit_length()))
    sample = good.select("v").orderBy(F.xxhash64("v", "id")).limit(SAMPLE).toPandas()["v"].tolist()
    tree = good.sparkSession.sparkContext.broadcast(Tree.of(_padded(sample, dim), depth))  # 2^depth splits, which the sample bounds

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column(1).to_pylist(), dim)
            yield _batch([batch.column(0), batch.column(2), pa.array(tree.value.leaves(x)), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], "id asks leaf x")

    placed = durable(good.select("id", "v", "asks").mapInArrow(place, "id long, asks boolean, leaf long, x binary"))
    sizes, first = [], 0
    for r in placed.groupBy("leaf").count().orderBy("leaf").collect():  # 2^depth leaves at most
        pieces = -(-r["count"] // SHARD)
        sizes.append((r["leaf"], first, pieces))
        first += pieces
    numbers = good.sparkSession.createDataFrame(sizes, "leaf long, first long, pieces long")
    shard = F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))
    dealt = placed.join(F.broadcast(numbers), "leaf").select(shard.alias("shard"), "id", "asks", "x").repartition("shard").sortWithinPartitions("shard")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for number, members in groupby(stream, key=lambda r: r[0]):
            held = list(members)
            x = np.frombuffer(b"".join(m[3] for m in held), kind).reshape(-1, dim)
            center = x.mean(axis=0)
            radius = float(np.sqrt(((x - center) ** 2).sum(axis=1)).max())
            bounds = [pa.array([v.astype(float).tobytes()], pa.binary()) for v in (x.min(axis=0), x.max(axis=0), center)]
            ids, asks = np.array([m[1] for m in held], np.int64), np.array([m[2] for m in held], bool)
            yield _batch([pa.array([number]), pa.array([ids.tobytes()], pa.binary()), pa.array([asks.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), *bounds, pa.array([radius])], "shard ids asks x low high center radius")

    return durable(dealt.mapInArrow(pack, "shard long, ids binary, asks binary, x binary, low binary, high binary, center binary, radius double"))


def top_k(rows: DataFrame, queries: Column, k: int = 20, scale: int = 64, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best others by inner product of the quantised vectors.

    queries: which rows are queries; every usable row is a candidate, except for the query's own id. Ties go to the
    smaller id. Vectors that are null or hold null or non-finite components, and rows without an id, take no part;
    missing components of shorter vectors count 0. Scores are exact up to 63 bits; larger ones are an error. Repeated rows of the same id and vector count once. Queries with
    fewer than k candidates return all of them; an empty table gives an empty table.
    """
    good = rows.select(F.col(vec_id).cast("long").alias("id"), quantised(vector, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    good = durable(good.where(F.col("id").isNotNull() & F.col("v").isNotNull()).dropDuplicates(["id", "v"]))
    most = F.max(F.array_max(F.transform("v", F.abs)))
    size = good.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.coalesce(most, F.lit(0)).alias("most")).first()
    dim, kind = max(1, size["dim"]), np.dtype(np.int16 if size["most"] < 1 << 15 else np.int64)
    shards = _shards(good, size["n"], dim, kind)
    reach = size["most"] ** 2 * dim
    lost = reach * 1e-12 if reach >= EXACT else 0.0  # by bounds in doubles

    def vectors(data: bytes) -> np.ndarray:
        return np.frombuffer(data, kind).reshape(-1, dim)

    asked = "shard ids q floors query_id vec_id score"

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, asks, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, x = np.frombuffer(ids, np.int64), vectors(x)
                mine = np.flatnonzero(np.frombuffer(asks, bool))
                for lo in range(0, len(mine), QUERY_BLOCK):
                    part = mine[lo : lo + QUERY_BLOCK]
                    block = Block(ids[part], x[part], k).search(ids, x)
                    none = lambda n, t: pa.nulls(n, t)
                    yield _batch([pa.array([number]), *(pa.array([d.tobytes()], pa.binary()) for d in (ids[part], x[part], block.floor)), *[none(1, pa.int64())] * 3], asked)
                    n = len(block.at)
                    yield _batch([none(n, pa.int64()), *[none(n, pa.binary())] * 3, *block.results()], asked)

    home = durable(shards.select("shard", "ids", "asks", "x").mapInArrow(at_home, "shard long, ids binary, q binary, floors binary, query_id long, vec_id long, score long"))
    groups = max(1, -(-size["q"] // GROUP))
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    empty = [F.lit(None).cast("binary").alias(c) for c in ("low", "high", "center")]
    waiting = home.where("shard is not null").select(F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("turn"), "shard", "ids", "q", "floors", *empty, F.lit(None).cast("double").alias("radius"))
    bounds = shards.select(group.alias("group"), F.lit(1).alias("turn"), "shard", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "q", "floors")], "low", "high", "center", "radius")
    met = waiting.unionByName(bounds).repartition("group").sortWithinPartitions("group", "turn", "shard")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's queries are held (about GROUP of them), and the shards' bounds pass by, RUN at a time."""
        stream = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for _, members in groupby(stream, key=lambda r: r[0]):
            held: list[tuple] = []
            run: list[tuple] = []
            ready: tuple | None = None
            for r in members:
                if r[1] == 0:
                    held.append(r)
                    continue
                ready = ready or _joined(held)
                run.append(r)
                if len(run) == RUN:
                    yield from _reached(*ready, run)
                    run = []
            if run and held:
                yield from _reached(*ready, run)

    def _joined(held: list[tuple]) -> tuple:
        ids = [np.frombuffer(r[3], np.int64) for r in held]
        return (np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros((0, dim), kind), *(vectors(r[4]) for r in held)]), np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[5], np.int64) for r in held)]), np.repeat([r[2] for r in held], list(map(len, ids))))

    def _reached(ids: np.ndarray, q: np.ndarray, floors: np.ndarray, homes: np.ndarray, run: list[tuple]) -> Iterator[pa.RecordBatch]:
        low, high, center = (np.array([np.frombuffer(r[c]) for r in run]) for c in (6, 7, 8))
        radius, numbers = np.array([r[9] for r in run]), np.array([r[2] for r in run])
        for lo in range(0, len(ids), 4096):
            part = q[lo : lo + 4096].astype(float)
            terms = np.maximum(part, 0) @ high.T + np.minimum(part, 0) @ low.T + lost
            ball = part @ center.T + np.sqrt((part**2).sum(axis=1))[:, None] * radius
            near = (np.minimum(terms, ball * (1 + 1e-9) + 1e-3) >= floors[lo : lo + 4096, None]) & (homes[lo : lo + 4096, None] != numbers)
            for s in np.flatnonzero(near.any(axis=0)):
                chosen = lo + np.flatnonzero(near[:, s])
                for at in range(0, len(chosen), QUERY_BLOCK):
                    some = chosen[at : at + QUERY_BLOCK]
                    yield _batch([pa.array([int(numbers[s])]), *(pa.array([d.tobytes()], pa.binary()) for d in (ids[some], q[some], floors[some]))], "to asking q floors")

    sent = durable(met.mapInArrow(send, "to long, asking binary, q binary, floors binary"))
    pairs = sent.join(shards.select("shard", "ids", "x"), F.col("to") == F.col("shard")).select("asking", "q", "floors", "ids", "x")

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                asking, q, floors, ids, x = (batch.column(c)[r].as_py() for c in range(5))
                block = Block(np.frombuffer(asking, np.int64), vectors(q), k, np.frombuffer(floors, np.int64)).search(np.frombuffer(ids, np.int64), vectors(x))
                yield _batch(list(block.results()), "query_id vec_id score")

    best = home.where("shard is null").select("query_id", "vec_id", "score").unionByName(pairs.mapInArrow(away, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
