"""Near-copies by Jaccard similarity of word n-gram sets: MinHash banding, then exact verification.

1. Texts with equal n-gram sets are one class; from here on classes stand for their texts.
2. A class's MinHash signature is cut into bands; bands and rows are chosen so that a pair at the threshold shares a band
   with the target probability. Classes that share a band hash hang on the smallest one of the bucket: as many edges as
   bucket members. The connected components of these edges hold every pair that shares a band.
3. A component that fits one block of bounded size is one unit; of a larger one each bucket is, so a long chain of
   look-alikes costs what its buckets cost. Buckets with the same members count once. A unit is cut into blocks, and each
   pair of blocks is one group: there, pairs that share a bucket are verified on their whole n-gram sets, each
   pair in its smallest bucket. A group gives one row per class: its verified links and its root among them, so neither
   candidates nor links are ever rows of their own.
4. The connected components of (class, root) are the near-copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.llm.components import components
from crateflow.llm.runtime import drop_table, durable, text_blocks, write_table

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9998, 8
#: Limits of a block: classes, and bytes of n-gram hashes.
BLOCK_CLASSES, BLOCK_SET_BYTES = 512, 8 << 20
_SEED = 20_240_229
_MASK = (1 << 64) - 1


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The bands of so many rows with which a pair at the threshold shares at least one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


#: A task's; emptied at its end, so that an idle worker doesn't hold it through all later steps.
_HASHES = _WordHashes()


def _forget_words() -> None:
    """For functions that travel to the workers: those would bring a copy of _HASHES of their own."""
    _HASHES.clear()


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-cased (A-Z) words between ASCII blanks.

    Fewer words than `size` are one n-gram together; no word, no n-gram.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(one) - size + 1)
    mixed = np.full(n, len(one) if len(one) < size else size, np.uint64)
    for k in range(min(size, len(one))):
        mixed = (mixed ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


class Signer:
    """MinHash band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(_SEED)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.fold = rng.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.start = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        short = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(short), 256):
            np.minimum(least, (short[lo : lo + 256, None] * self.a + self.b).min(axis=0), out=least)
        mixed = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.fold).sum(axis=1, dtype=np.uint64) + self.start
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (mixed ^ (mixed >> np.uint64(30))).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(id, mark, f1, f2, n, bands) per row of docs (id, mark, text); f1, f2: 128 bits of the set; null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        try:
            for batch in batches:
                for lo, hi in text_blocks(batch, 2):
                    sets = [shingles(t, size) for t in batch.column(2).slice(lo, hi - lo).to_pylist()]
                    f1 = [int(np.bitwise_xor.reduce(s * np.uint64(0xD6E8FEB86659FD93) ^ (s >> np.uint64(17)))) if len(s) else None for s in sets]
                    f2 = [(int(s.sum(dtype=np.uint64)) ^ len(s) << 40) & _MASK if len(s) else None for s in sets]
                    signed = [x if x is None or x < 1 << 63 else x - (1 << 64) for x in f1], [x if x is None or x < 1 << 63 else x - (1 << 64) for x in f2]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(signed[0], pa.int64()), pa.array(signed[1], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signer(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                        ["id", "mark", "f1", "f2", "n", "bands"],
                    )
        finally:
            _forget_words()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, mark long, f1 long, f2 long, n long, bands array<long>")


def _candidates(left: list, right: list, unit: int, whole: bool) -> np.ndarray:
    """Which of left and right meet here: in a whole component those with a bucket in common, else those with none before the unit's."""
    held: dict[int, tuple[list[int], list[int]]] = {}
    for side, block in enumerate((left, right)):
        for k, x in enumerate(block):
            for bucket in x[3]:
                held.setdefault(bucket, ([], []))[side].append(k)
    fit = np.full((len(left), len(right)), not whole)
    for bucket, (i, j) in held.items():
        if i and j and (whole or bucket < unit):
            fit[np.ix_(i, j)] = whole
    return fit


def _linked(left: list, right: list, same: bool, unit: int, whole: bool, threshold: float) -> list[tuple[int, int]]:
    """Index pairs of verified links between two blocks of (cls, weight, set, buckets); same: both are one block."""
    sizes_a, sizes_b = np.array([len(x[2]) for x in left]), np.array([len(x[2]) for x in right])
    fit = _candidates(left, right, unit, whole)
    fit &= np.minimum(sizes_a[:, None], sizes_b) >= threshold * np.maximum(sizes_a[:, None], sizes_b) - 1e-9
    if same:
        fit = np.triu(fit, 1)
    i, j = np.nonzero(fit)
    if len(i) <= 4 * (len(left) + len(right)):
        common = np.array([len(np.intersect1d(left[x][2], right[y][2], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:
        common = _common(left, right)[i, j]
    keep = common * (1 + threshold) >= threshold * (sizes_a[i] + sizes_b[j]) - 1e-9 if len(i) else np.zeros(0, bool)
    return list(zip(i[keep].tolist(), j[keep].tolist(), strict=True))


def _common(left: list, right: list) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over some n-grams at a time."""
    both = np.intersect1d(np.unique(np.concatenate([x[2] for x in left])), np.unique(np.concatenate([x[2] for x in right])), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(both), 2048):
        part = both[lo : lo + 2048]
        sides = []
        for block in (left, right):
            ones = np.zeros((len(block), len(part)), np.float32)
            for k, x in enumerate(block):
                within = x[2][np.searchsorted(x[2], part[0]) : np.searchsorted(x[2], part[-1], "right")]
                at = np.searchsorted(part, within)
                ones[k, at[part[at] == within]] = 1
            sides.append(ones)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """(cls, links, texts, root) per class and group; rows: unit, whole, bi, bj, blk, cls, weight, hashes, buckets, dealt by the first four."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out: list[tuple[int, int, int, int]] = []
        for (unit, whole, bi, bj), members in groupby(stream, key=lambda r: r[:4]):
            sides: dict[int, dict[int, tuple]] = {bi: {}, bj: {}}
            for *_, blk, cls, weight, hashes, buckets in members:
                sides[blk][cls] = (cls, weight, np.frombuffer(hashes, np.uint64), buckets)
            left, right = list(sides[bi].values()), list(sides[bj].values())
            if not left or not right:
                continue
            found: dict[int, list[int]] = {x[0]: [0, 0] for x in [*left, *right]}
            root = {x: x for x in found}

            def top(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in _linked(left, right, bi == bj, unit, whole, threshold):
                x, y = left[i], right[j]
                for p, q in ((x, y), (y, x)):
                    found[p[0]][0] += q[1]
                    found[p[0]][1] += 1
                p, q = sorted((top(x[0]), top(y[0])))
                root[q] = p
            out.extend((x, links, texts, top(x)) for x, (links, texts) in found.items() if texts)
            if len(out) > 10_000:
                yield _rows(out)
                out = []
        yield _rows(out)

    def _rows(out: list) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cls", "links", "texts", "root"])

    return rows.mapInArrow(check, "cls long, links long, texts long, root long")


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """(cls, bucket, head) for the buckets of two classes or more, head the smallest; one bucket of those with the same members.

    Members are summed up only over shared buckets, so the rows of all buckets are dealt with few bytes. Merge joins at every
    size: shared buckets have no bound, and so what is moved grows in proportion to the documents.
    """
    spots = classes.select("cls", F.posexplode("bands").alias("band", "hash")).select("cls", F.xxhash64("band", "hash").alias("bucket"))
    full = spots.groupBy("bucket").agg(F.min("cls").alias("head"), F.count("*").alias("m")).where("m > 1").select(F.col("bucket").alias("b"), "head", "m")
    met = spots.join(full.hint("merge"), F.col("bucket") == F.col("b")).select("cls", "bucket", "head", "m")
    members = [F.bit_xor(F.xxhash64("cls")).alias("x1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x2")]
    once = met.groupBy("bucket", "head", "m").agg(*members).groupBy("head", "m", "x1", "x2").agg(F.min("bucket").alias("b")).select("b")
    return met.join(once.hint("merge"), F.col("bucket") == F.col("b"), "left_semi").select("cls", "bucket", "head")


def _units(grouped: DataFrame, shared: DataFrame) -> DataFrame:
    """(cls, units, buckets) per class of grouped (cls, n, part): its units (unit, whole, blocks) and its shared buckets, `bands` at most."""
    blocks = F.expr(f"greatest(ceil(count(*) / {BLOCK_CLASSES}), ceil(8 * sum(n) / {BLOCK_SET_BYTES}))").cast("int").alias("blocks")
    placed = grouped.join(grouped.groupBy(F.col("part").alias("p")).agg(blocks), F.col("part") == F.col("p"))
    whole = placed.where("blocks = 1").select("cls", F.col("part").alias("unit"), F.lit(True).alias("whole"), "blocks")
    spread = placed.where("blocks > 1").select(F.col("cls").alias("c"), "n").join(shared, F.col("c") == F.col("cls")).select("cls", "n", "bucket")
    sized = spread.groupBy(F.col("bucket").alias("unit")).agg(blocks)
    split = spread.join(sized, F.col("bucket") == F.col("unit")).select("cls", "unit", F.lit(False).alias("whole"), "blocks")
    units = whole.unionByName(split).groupBy("cls").agg(F.collect_list(F.struct("unit", "whole", "blocks")).alias("units"))
    buckets = shared.groupBy(F.col("cls").alias("c")).agg(F.collect_list("bucket").alias("buckets"))
    return units.join(buckets, F.col("cls") == F.col("c")).select("cls", "units", "buckets")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WORDS, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """A row per row of docs: its id, mark (xxhash64 of the text), class_id, text_class, n_links, n_text_links, kept, class_key.

    text_class: the smallest id whose text has the same n-grams; class_id: the smallest id reachable by links; n_links:
    the other rows linked directly, copies included; n_text_links: the other classes of equal n-gram sets linked
    directly; kept: whether the row has the class's id, so one id of each class stays; class_key: a number of the class, null
    without words. A text without words (null,
    empty or blank) links with nothing and is its own class. Repeated rows are copies of each other, and as they
    share an id they are kept or not together; a null id is larger than all others. Texts are compared whole. An empty
    table gives an empty table.
    """
    bands = bands_for(threshold, rows, recall)
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sets = durable(signatures(keyed, bands, rows, size))
    classes = sets.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct(F.col("id").isNull().alias("blank"), "id", "mark")).alias("least"), F.count("*").alias("weight"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    unnumbered, spare = write_table(classes.select("f1", "f2", F.col("least.id").alias("rep"), F.col("least.mark").alias("rep_mark"), "weight", "n", "bands"))  # one row gives both
    classes, classes_path = write_table(unnumbered.withColumn("cls", F.monotonically_increasing_id()))  # written, so the numbers stay
    drop_table(docs.sparkSession, spare)
    shared, shared_path = write_table(_shared_buckets(classes))
    candidates = components(shared.where("cls <> head").select(F.col("cls").alias("u"), F.col("head").alias("v")))
    grouped, grouped_path = write_table(classes.join(candidates, F.col("cls") == F.col("node")).select("cls", "n", F.col("component").alias("part")))
    units = _units(grouped, shared).withColumnRenamed("cls", "c")
    wanted, wanted_path = write_table(classes.join(units, F.col("cls") == F.col("c")).select("cls", "rep", "rep_mark", "weight", "units", "buckets"))
    texts = keyed.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark"))).select("units", "cls", "weight", "buckets", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for lo, hi in text_blocks(batch, 4):
                    sets_ = [shingles(t, size).tobytes() for t in batch.column(4).slice(lo, hi - lo).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(lo, hi - lo) for k in range(4)] + [pa.array(sets_, pa.binary())], ["units", "cls", "weight", "buckets", "hashes"])
        finally:
            _forget_words()

    ready = texts.mapInArrow(hashed, "units array<struct<unit:bigint,whole:boolean,blocks:int>>, cls long, weight long, buckets array<long>, hashes binary")
    ready = ready.select(F.explode("units").alias("u"), "cls", "weight", "hashes", "buckets").select("u.*", F.pmod(F.xxhash64("cls"), F.col("u.blocks")).cast("int").alias("blk"), "cls", "weight", "hashes", "buckets")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("blk", k).alias("bi"), F.greatest("blk", k).alias("bj")))
    dealt = ready.select("unit", "whole", F.explode(pairs).alias("pair"), "blk", "cls", "weight", "hashes", "buckets").select("unit", "whole", "pair.bi", "pair.bj", "blk", "cls", "weight", "hashes", "buckets")
    dealt = dealt.repartition("unit", "whole", "bi", "bj").sortWithinPartitions("unit", "whole", "bi", "bj")
    found, found_path = write_table(_verify(dealt, threshold))
    for path in (shared_path, grouped_path, wanted_path):
        drop_table(docs.sparkSession, path)
    groups = components(found.where("root <> cls").select(F.col("cls").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts")).withColumnRenamed("cls", "c")
    named = classes.select("cls", "f1", "f2", "rep", "weight").join(groups, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy(F.col("component").alias("k")).agg(F.min("rep").alias("class_id"))
    verdict = named.join(least, F.col("component") == F.col("k")).join(links, F.col("cls") == F.col("c"), "left")
    verdict = durable(verdict.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "class_id", F.col("component").alias("class_key"), F.col("rep").alias("text_class"), "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")))
    for path in (classes_path, found_path):
        drop_table(docs.sparkSession, path)
    out = sets.select("id", "mark", "f1", "f2", "n").join(verdict, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    worded = F.col("n") > 0
    out = out.withColumn("class_id", F.when(worded, F.col("class_id")).otherwise(F.col("id"))).withColumn("text_class", F.when(worded, F.col("text_class")).otherwise(F.col("id")))
    return out.select(
        F.col("id").alias("doc_id"), "mark", "class_id", "text_class",
        F.when(worded, F.col("weight") - 1 + F.col("links")).otherwise(0).cast("long").alias("n_links"),
        F.when(worded, F.col("texts")).otherwise(0).cast("long").alias("n_text_links"),
        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "class_key",
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with one document of each class of near_copies(), which tells the options and the edge cases."""
    kept = near_copies(docs, text, doc_id, **options).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("mark"))
    rows = whole.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "left_semi")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_one_row(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """As keep_one(), but one row of each class even where rows share an id.

    Of the rows with the smallest id that of the least mark stays, and of its repetitions the first as they lie. Rows without words
    are no copies: all stay. Rows are chosen by their number, on narrow rows, and are then moved once, by a merge join at every size: what
    is chosen has no bound, and so disk and time grow in proportion. docs: a written table, or whatever gives the same rows in the
    same partitions each time. No column's name can clash; an empty table gives an empty table.
    """
    found = near_copies(docs, text, doc_id, **options).where("kept")
    alone = F.col("class_key").isNull()
    kept = found.groupBy("class_key", F.when(alone, F.col("doc_id")).alias("own_id"), F.when(alone, F.col("mark")).alias("own_mark")).agg(F.min(F.struct("mark", "doc_id")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.mark").alias("kept_mark"), F.col("class_key").isNotNull().alias("once"))
    number = F.monotonically_increasing_id().alias("number")
    narrow = docs.select(number, F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("mark"))
    rows = narrow.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")))
    chosen = rows.groupBy("id", "mark", F.when(~F.col("once"), F.col("number")).alias("own")).agg(F.min("number").alias("chosen")).select("chosen")
    whole = docs.select(number, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stays = whole.join(durable(chosen).hint("merge"), F.col("number") == F.col("chosen"), "left_semi")
    return stays.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
