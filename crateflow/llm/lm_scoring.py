"""Language-model scores of texts by context-tree weighting over bytes, beside a unigram base over tokens.

A text is the bytes of its lower-cased (A-Z) form and an end mark. A byte is eight binary decisions, each with a context
tree of its own: the node of depth d is told apart by the last d bytes and the bits decided so far. A node's counts come
from all training texts; its Krichevsky-Trofimov estimate competes with the product of its children's weighted
probabilities, half and half, which gives the node's weight against the deeper ones. A bit's probability mixes the
estimates along the path of its context by these weights; where training has not seen a longer context the path ends.

All counts are of windows of DEPTH + 1 bytes, as shorter contexts' counts are sums of them. Windows (and tokens, by a
61-bit hash) are counted over all texts, summed by key, and the trees are weighted from the leaves up: depths 3 and more
where the windows of their three nearest context bytes meet, depth 2 by a sum over depth 3's nodes, and depths 0 and 1,
at most 2 * 2^16 numbers, on the driver. On the way down each window gets one log probability.
The HOT most frequent windows and tokens are broadcast, a bounded table; the others are joined by key, so that no join
key is frequent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.runtime import KeyCounts, durable, runs, text_blocks

#: Bytes of context. With HOT a power of two each broadcast table has 16 * HOT to 32 * HOT bytes.
DEPTH, HOT = 5, 1 << 18
#: What a task holds at a time: bytes of text as windows of 8 bytes each, and keys that it counts.
BLOCK, MOST_KEYS = 1 << 19, 1 << 19
#: Windows that a task weighs at a time, and into how many groups those of two nearest bytes are dealt.
WEIGHED, DEALT = 1 << 15, 16
#: Bytes that UTF-8 never has: what stands before a text, and its end.
PAD, END = 0xFE, 0xFF
_TOKEN = 1 << 61
_HALF = math.log(0.5)


class _TokenKeys(dict):
    """Keys of tokens: bit 61 and a hash. The empty token is the text's end."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = key = _TOKEN | xxhash.xxh3_64_intdigest(word) >> 3
        return key


_KEYS = _TokenKeys()
END_KEY = _TokenKeys()[b""]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token keys of all texts in order, each text's end last, and how many each text has."""
    get = _KEYS.__getitem__
    lists = [[*map(get, t.split()), END_KEY] for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _windows(texts: list[bytes], depth: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of depth context bytes and a byte (the lowest) of all texts in order, and each one's text, a block at a time.

    Texts of any length: a longer one goes through several blocks.
    """
    data = b"".join([p for t in texts for p in (bytes([PAD]) * depth, t, b"\xff")])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + depth + 1)
    for lo in range(depth, len(data), block):
        part = np.frombuffer(data, np.uint8, min(len(data), lo + block) - lo + depth, lo - depth).astype(np.int64)
        out = part[: len(part) - depth].copy()
        for k in range(1, depth + 1):
            out <<= 8
            out |= part[k : len(part) - depth + k]
        place = np.arange(lo, lo + len(out))
        owner = np.searchsorted(ends, place, "right")
        real = place >= np.concatenate(([0], ends[:-1]))[owner] + depth  # others end in a text's padding
        yield out[real], owner[real]


def _lowered(column: pa.Array) -> list[bytes]:
    return [t.encode().lower() if t else b"" for t in column.to_pylist()]


def count_keys(docs: DataFrame, depth: int) -> DataFrame:
    """(key, n_train, n_all) of all tokens and windows. docs: trains (boolean), text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = KeyCounts(1, MOST_KEYS)

        def out() -> pa.RecordBatch:
            keys, n = held.flush()
            return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array((keys & 1).astype(bool)), pa.array(n[:, 0])], ["key", "trains", "n"])

        for batch in batches:
            trains = np.array(batch.column(0).to_pylist(), bool).astype(np.int64)
            for lo, hi in text_blocks(batch, 1, BLOCK):
                texts = _lowered(batch.column(1).slice(lo, hi - lo))
                words, sizes = _words(texts)
                for keys, of in chain([(words, np.repeat(np.arange(len(texts)), sizes))], _windows(texts, depth)):
                    keys, n = runs(keys << 1 | trains[lo:hi][of])
                    held.add(keys, n[:, None])
                    if held.full():
                        yield out()
        yield out()

    rows = docs.mapInArrow(count, "key long, trains boolean, n long")
    return rows.groupBy("key").agg(F.sum(F.when(F.col("trains"), F.col("n")).otherwise(0)).alias("n_train"), F.sum("n").alias("n_all"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; x >= 0.5."""
    shifted, low = x + 8.0, np.zeros(x.shape)
    for k in range(8):
        low += np.log(x + k)
    inverse = 1 / shifted
    square = inverse * inverse
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680))) - low


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1)


@dataclass
class Nodes:
    """Nodes of one depth: sorted keys (context, decided bits), counts, estimates of a one, log weighted probability, weight."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_weighted: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> Nodes:
        own = _log_kt(zeros, ones)
        if children is None:
            return Nodes(keys, zeros, ones, own, np.ones(len(keys)))
        both = np.logaddexp(_HALF + own, _HALF + children)
        return Nodes(keys, zeros, ones, both, np.exp(_HALF + own - both))

    def mix(self, keys: np.ndarray, bits: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probabilities of bits at nodes, given those from the deeper nodes (nan: there is none)."""
        if not len(self.keys):
            return deeper
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        one = (self.ones[at] + 0.5) / (self.zeros[at] + self.ones[at] + 1)
        own, w = np.where(bits == 1, one, 1 - one), self.weight[at]
        mixed = np.where(np.isnan(deeper), own, w * own + (1 - w) * deeper)
        return np.where(self.keys[at] == keys, mixed, deeper)


def _decisions(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the eight bits of each window's byte: the bits before with a leading one, and the bit."""
    byte = (windows & 0xFF)[:, None]
    place = np.arange(8)
    return (1 << place) | (byte >> (8 - place)), (byte >> (7 - place)) & 1


def _keys(windows: np.ndarray, before: np.ndarray, depth: int) -> np.ndarray:
    return (((windows >> 8) & ((1 << 8 * depth) - 1))[:, None] << 8) | before


def grow(windows: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[np.ndarray, Nodes]:
    """Mixed probabilities of each window's bits over depths least..depth (nan: unseen), and the nodes of depth least.

    windows hold all those of their contexts of depth `least`; n: training counts.
    """
    seen = windows[n > 0]
    before, bits = _decisions(seen)
    counts = np.repeat(n[n > 0].astype(float), 8)
    levels: list[Nodes] = []
    for d in range(depth, least - 1, -1):
        keys, at = np.unique(_keys(seen, before, d).ravel(), return_inverse=True)
        ones = np.bincount(at, counts * bits.ravel(), len(keys))
        zeros = np.bincount(at, counts, len(keys)) - ones
        children = None
        if levels:
            below = levels[-1]
            parents = np.searchsorted(keys, (below.keys >> 8 & ((1 << 8 * d) - 1)) << 8 | below.keys & 0xFF)
            children = np.bincount(parents, below.log_weighted, len(keys))
        levels.append(Nodes.of(keys, zeros, ones, children))
    before, bits = _decisions(windows)
    p = np.full(bits.shape, np.nan)
    for d, level in zip(range(depth, least - 1, -1), levels, strict=True):
        p = level.mix(_keys(windows, before, d), bits, p)
    return p, levels[-1]


def finish(windows: np.ndarray, p: np.ndarray, tops: list[Nodes]) -> np.ndarray:
    """log10 of each window's byte; tops: the nodes of the depths above p's, deepest first."""
    before, bits = _decisions(windows)
    for d, level in zip(range(len(tops) - 1, -1, -1), tops, strict=True):
        p = level.mix(_keys(windows, before, d), bits, p)
    return np.log10(np.where(np.isnan(p), 0.5, p)).sum(axis=1)


def top_levels(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> list[Nodes]:
    """Depths 1 and 0, from depth 1's keys, counts and sums of their children's log weighted probabilities."""
    order = np.argsort(keys)
    first = Nodes.of(keys[order], zeros[order], ones[order], children[order])
    bits, at = np.unique(first.keys & 0xFF, return_inverse=True)
    root = Nodes.of(bits, *(np.bincount(at, x, len(bits)) for x in (first.zeros, first.ones, first.log_weighted)))
    return [first, root]


def _above(depth: int) -> Column:
    """The key of the node of this depth above a deeper node."""
    return F.expr(f"(shiftright(key, 8) & {(1 << 8 * depth) - 1}) * 256 + (key & 255)").alias("key")


def weigh(counts: DataFrame, depth: int) -> DataFrame:
    """(key, value): log10 probability of the last byte of every window. counts: key, n_train; depth is 3 at least."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(windows: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            p, nodes = grow(windows, n, depth, 3)
            yield batch_of(windows, p.astype(np.float32), None, None, None)
            yield batch_of(nodes.keys, None, nodes.zeros, nodes.ones, nodes.log_weighted)

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in (1, 2)]))
            size += batch.num_rows
            if size < WEIGHED:
                continue
            rows = np.concatenate(held, axis=1)
            whole = _last_start(rows[0], 3)
            if whole:
                yield from out(rows[0, :whole], rows[1, :whole])
            held, size = [rows[:, whole:]], rows.shape[1] - whole
        if size:
            rows = np.concatenate(held, axis=1)
            yield from out(rows[0], rows[1])

    def batch_of(keys, p, zeros, ones, weighted) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(keys), kind)
        probabilities = none(pa.binary()) if p is None else pa.array([r.tobytes() for r in p], pa.binary())
        numbers = [none(pa.float64()) if x is None else pa.array(x, pa.float64()) for x in (zeros, ones, weighted)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), probabilities, *numbers], ["key", "p", "zeros", "ones", "weighted"])

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = Nodes.of(*(batch.column(k).to_numpy() for k in range(4)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes.log_weighted), pa.array(nodes.weight)], ["key", "zeros", "ones", "weighted", "weight"])

    dealt = counts.select(F.expr("shiftright(key, 8) & 16777215").alias("near"), "key", "n_train").repartition("near").sortWithinPartitions("near")
    parts = durable(dealt.mapInArrow(local, "key long, p binary, zeros double, ones double, weighted double"))
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]
    second = parts.where("p is null").groupBy(_above(2)).agg(*sums)
    second = durable(second.mapInArrow(weighted, "key long, zeros double, ones double, weighted double, weight double"))
    first = second.groupBy(_above(1)).agg(*sums).toPandas()  # 2^16 rows at most
    tops = counts.sparkSession.sparkContext.broadcast(top_levels(*(first[c].to_numpy(t) for c, t in (("key", np.int64), ("zeros", float), ("ones", float), ("weighted", float)))))

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: np.ndarray | None = None  # the nodes of the last group: 255 at most
        for batch in batches:
            near, group, key = (batch.column(k).to_numpy() for k in range(3))
            is_node = batch.column(3).is_null().to_numpy(zero_copy_only=False)
            nodes = np.stack([key[is_node].astype(float), *(batch.column(k).filter(pa.array(is_node)).to_numpy() for k in (4, 5, 6)), near[is_node], group[is_node]])
            nodes = nodes if carried is None else np.concatenate([carried, nodes], axis=1)
            windows = key[~is_node]
            if len(windows):
                level = nodes[:, np.argsort(nodes[0], kind="stable")]
                p = np.frombuffer(b"".join(batch.column(3).filter(pa.array(~is_node)).to_pylist()), np.float32).reshape(-1, 8).astype(float)
                before, bits = _decisions(windows)
                p = Nodes(level[0].astype(np.int64), level[1], level[2], level[3], level[3]).mix(_keys(windows, before, 2), bits, p)
                yield pa.RecordBatch.from_arrays([pa.array(windows), pa.array(finish(windows, p, tops.value))], ["key", "value"])
            carried = nodes[:, (nodes[4] == near[-1]) & (nodes[5] == group[-1])] if len(near) else carried

    group = F.expr(f"cast(pmod(shiftright(key, 24), {DEALT}) as int)")
    windows = parts.where("p is not null").select(F.expr("shiftright(key, 8) & 65535").alias("near"), group.alias("group"), "key", "p", *[F.lit(None).cast("double").alias(c) for c in ("zeros", "ones", "weight")])
    every = second.select(F.shiftright("key", 8).alias("near"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("group"), "key", F.lit(None).cast("binary").alias("p"), "zeros", "ones", "weight")
    both = windows.unionByName(every).repartition("near", "group").sortWithinPartitions("near", "group", F.col("p").isNotNull())
    return both.mapInArrow(complete, "key long, value double")


def _last_start(windows: np.ndarray, depth: int) -> int:
    """Where the last run of equal nearest bytes begins."""
    near = windows >> 8 & ((1 << 8 * depth) - 1)
    changes = np.flatnonzero(near[1:] != near[:-1])
    return int(changes[-1]) + 1 if len(changes) else 0


class Places:
    """Where in an array of 64-bit keys (not negative) a key stands, by open addressing, for looking up whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys, self.place = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            where, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[where], self.place[where] = keys[put], put
            stay = self.keys[slot] != keys[left]
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for unknown keys."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.place[slot], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.place[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def _hot(counts: DataFrame, most: int) -> Column:
    """Whether a key is among the most frequent tokens or windows, `most` of each at most: a least count for each kind."""
    size = F.floor(F.log2("n_all") * 16).cast("int")
    levels = counts.groupBy((F.col("key") >= _TOKEN).alias("token"), size.alias("size")).count().collect()  # 16 a doubling
    least = {}
    for token in (True, False):
        total, bound = 0, math.inf
        for r in sorted((r for r in levels if r["token"] == token), key=lambda r: -r["size"]):
            total += r["count"]
            if total > most:
                break
            bound = r["size"]
        least[token] = bound
    return size >= F.when(F.col("key") >= _TOKEN, F.lit(float(least[True]))).otherwise(F.lit(float(least[False])))


def score(docs: DataFrame, trains: Column, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """A row per row: doc_id, trains, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    trains tells the rows that the model learns from (null: not). A null text is empty; an empty text is its end alone.
    Scores are log10 probabilities of the whole text with its end. Repeated rows are counted and scored each. Without
    training texts every bit has probability 1/2 and base_score is null. An empty table gives an empty table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(trains, F.lit(False)).alias("trains"), F.col(text).alias("text"))
    counts = durable(count_keys(rows.select("trains", "text"), depth))
    tokens, windows = counts.where(F.col("key") >= _TOKEN), counts.where(F.col("key") < _TOKEN)
    size = tokens.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.count_if(F.col("n_train") > 0).alias("v")).first()
    spread = size["n"] + 0.5 * (size["v"] + 1)
    base = F.log10((F.col("n_train") + 0.5) / F.lit(float(spread)))
    values = weigh(windows, depth).withColumn("known", F.lit(False))
    model = durable(tokens.select("key", base.alias("value"), (F.col("n_train") > 0).alias("known")).unionByName(values))
    frequent = model.join(counts.where(_hot(counts, hot)).select("key"), "key", "left_semi").toArrow()
    table = docs.sparkSession.sparkContext.broadcast(tuple(frequent[c].to_numpy() for c in ("key", "value", "known")))
    del frequent
    kind = rows.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, worth, known = table.value
        places, worth, known = Places(keys), np.append(worth, 0.0), np.append(known, False).astype(float)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in text_blocks(batch, 2, BLOCK):
                texts = _lowered(batch.column(2).slice(lo, hi - lo))
                heads, parts = len(texts), []
                sums = np.zeros((6, heads))  # of tokens: value, known, number; of windows the same
                words, sizes = _words(texts)
                of_words = np.repeat(np.arange(heads), sizes)
                for first, (each, of) in chain([(0, (words, of_words))], ((3, x) for x in _windows(texts, depth))):
                    place = places.find(each)  # -1 is the entry added at the end
                    for k, x in enumerate((worth[place], known[place], None)):
                        sums[first + k] += np.bincount(of, x, heads)
                    rare = each[place < 0], of[place < 0]
                    order = np.lexsort(rare)
                    key, row = rare[0][order], rare[1][order]
                    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (key[1:] != key[:-1]))))
                    parts.append((row[starts] + number, key[starts], np.diff(np.append(starts, len(row)))))
                row, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                none = lambda t: pa.nulls(len(row), t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(np.arange(heads) + number), pa.array(row)]),
                        pa.concat_arrays([batch.column(0).slice(lo, heads), none(batch.column(0).type)]),
                        pa.concat_arrays([batch.column(1).slice(lo, heads), none(pa.bool_())]),
                        *[pa.concat_arrays([pa.array(x.astype(t)), none(pa.from_numpy_dtype(t))]) for x, t in ((sums[2], np.int64), (sums[1], np.int64), (sums[5] - 1, np.int64), (sums[0], np.float64), (sums[3], np.float64))],
                        pa.concat_arrays([pa.nulls(heads, pa.int64()), pa.array(key)]),
                        pa.concat_arrays([pa.nulls(heads, pa.int64()), pa.array(n)]),
                    ],
                    ["row", "doc_id", "trains", "n_tokens", "n_known", "n_bytes", "base", "score", "key", "n"],
                )
                number += heads

    applied = durable(rows.mapInArrow(apply, f"row long, doc_id {kind}, trains boolean, n_tokens long, n_known long, n_bytes long, base double, score double, key long, n long"))
    rare = applied.where("key is not null").select("row", "key", "n").join(model, "key")
    gains = rare.groupBy(F.col("row").alias("r")).agg(*[F.sum(F.when((F.col("key") >= _TOKEN) == token, F.col("n") * F.col("value")).otherwise(0.0)).alias(name) for name, token in (("b", True), ("s", False))], F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("k"))
    out = applied.where("key is null").join(gains, F.col("row") == F.col("r"), "left")
    total = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = out.select("doc_id", "trains", "n_tokens", total("n_known", "k").cast("long").alias("n_known"), F.lit(size["n"]).cast("long").alias("train_tokens"), (F.when(F.lit(size["n"]) > 0, total("base", "b"))).alias("base_score"), total("score", "s").alias("score"), "n_bytes")
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")))
