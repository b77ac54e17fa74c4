"""How far each group's words part from its language's and from its sister groups': top terms by upper bounds, pairs by postings.

A group is a (lang, source). With p and q the scaled smoothed probabilities of a term, f(p, q) = (p - q)^2 / q, floored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.llm.runtime import KeyCounts, durable, text_blocks
from crateflow.llm.words import BEYOND, LOWER, folding, parts

LETTERS = folding(LOWER + BEYOND)
SCALE = 1_000_000_000
#: Distinct (group, term) counts that a task holds before it gives them out.
HELD = 1 << 17
#: Pairs of postings that are worked on at a time.
PAIRS = 1 << 20
#: Counts up to this are buckets of their own; larger ones share FINE buckets for each factor of e.
EXACT, FINE = 256, 64


def counted(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents with it); each group also has a row with a null term and zeros.

    Nulls are read as ''. Counts are summed within a task first; a task holds HELD of them and one document's words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def given() -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for (a, b), (n, d) in held.items():
                for k, v in enumerate(([a] * (len(n) + 1), [b] * (len(n) + 1), [None, *n], [0, *n.values()], [0, *map(d.__getitem__, n)])):
                    columns[k] += v
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[2] = arrays[2].cast(pa.string())
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "d"])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_blocks(batch, 2):
                for k, t in enumerate(batch.column(2).slice(lo, hi - lo).cast(pa.binary()).to_pylist(), lo):
                    n, d = held.setdefault((langs[k], sources[k]), (Counter(), Counter()))
                    size -= len(n)
                    seen: set[bytes] = set()
                    for words in parts(t, LETTERS):
                        n.update(words)
                        seen.update(words)
                    d.update(seen)
                    size += len(n)
                    if size > HELD:
                        yield given()
                        size = 0
        yield given()

    blank = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]
    rows = docs.select(*blank).mapInArrow(count, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exact for any counts of 63 bits."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", scaled, (total + terms).cast("decimal(20,0)")) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, term, total and the postings (source, n) of the terms that enough documents of the language have."""
    some = counts.where(F.col("term").isNotNull()).groupBy("lang", "term")
    rows = some.agg(F.sum("n").alias("total"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return rows.where(F.col("d") >= least_docs).drop("d")


def group_stats(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, place (its number in the language), n (kept occurrences), m (kept terms it has), lang_n, v (terms of the language), p0."""
    per_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    per_group = terms.select("lang", F.explode("postings").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"), F.count("*").alias("m"))
    rows = counts.where(F.col("term").isNull()).select("lang", "source").join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["n", "m", "v", "lang_n"])
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")
    return rows.withColumn("place", place).withColumn("p0", F.when(F.col("v") > 0, probability(F.lit(0), F.col("n"), F.col("v"))))


def judged_postings(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """A row per kept term and group that has it: p, the language's q, and the group's place and p0."""
    rows = terms.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("c"))
    joined = rows.join(stats, ["lang", "source"])
    return joined.select("lang", "source", "term", "c", "place", "p0", probability(F.col("c"), F.col("n"), F.col("v")).alias("p"), probability(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k best terms of each group; each task sends k of a group at most."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_terms(postings: DataFrame, k: int = 200) -> DataFrame:
    """lang, source, item, value, rank of each group's k terms of the largest f(p, q) with p > q.

    Terms of a group are held in buckets by count. Within one, f is at most f of the largest p and the language's least q. Buckets are
    taken best bound first: at first until they hold k terms, whose k-th value is a floor; then all whose bound isn't
    below it. No other bucket can have a term that ranks, so its terms are neither evaluated nor put in order.
    """
    bucket = F.when(F.col("c") <= EXACT, F.col("c")).otherwise(EXACT + F.floor(F.ln(F.col("c").cast("double")) * FINE)).cast("long")
    rows = postings.where(F.col("p") > F.col("q")).select("lang", "source", "term", "p", "q", bucket.alias("bucket"))
    extremes = rows.groupBy("lang", "source", "bucket").agg(F.count("*").alias("size"), F.max("p").alias("high"), F.min("q").alias("low"))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    before = F.coalesce(F.sum("size").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = durable(extremes.withColumn("bound", _f(F.col("high"), F.col("low"))).withColumn("first", before < k).select("lang", "source", "bucket", "bound", "first"))

    def evaluated(buckets: DataFrame) -> DataFrame:
        some = rows.join(buckets, ["lang", "source", "bucket"], "left_semi")
        return _top(some.select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value")), k)

    begun = durable(evaluated(bounds.where("first")))
    floors = begun.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("floor"))
    more = bounds.where("not first").join(floors, ["lang", "source"]).where(F.col("bound") >= F.col("floor"))
    return _top(begun.drop("rank").unionByName(evaluated(more).drop("rank")), k)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of groups what their common terms add to the sums that take each group's other terms as absent."""
    codes: dict[str, int] = {}
    held = KeyCounts(1)

    def given() -> pa.RecordBatch:
        keys, sums = held.flush()
        names = pa.array(list(codes) or [None], pa.string())
        pair = keys & ((1 << 52) - 1)
        return pa.RecordBatch.from_arrays([names.take(pa.array(keys >> 52)), pa.array((pair >> 26).astype(np.int32)), pa.array((pair & ((1 << 26) - 1)).astype(np.int32)), pa.array(sums[:, 0])], names=["lang", "g", "h", "value"])

    for batch in batches:
        lists = batch.column(1)
        entries = lists.flatten()
        place, p, p0 = (entries.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        lang = np.array([codes.setdefault(x, len(codes)) for x in batch.column(0).to_pylist()], np.int64)
        start, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes[of])  # pairs up to each posting
        lo = 0
        while lo < len(of):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(ends.searchsorted(done + PAIRS, "right")))
            count = sizes[of[lo:hi]]
            a = np.repeat(np.arange(lo, hi), count)
            b = start[of[a]] + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            a, b = a[a != b], b[a != b]
            f = lambda x, y: (x - y) * (x - y) // y
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            held.add(lang[of[a]] << 52 | place[a] << 26 | place[b], value[:, None])
            if held.full():
                yield given()
            lo = hi
    yield given()


def pair_sums(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of f over all kept terms.

    Terms that a group lacks all have its p0. So a pair's sum is that of the one's terms against the other's p0, both ways, from the counts'
    histograms; p0 against p0 for what is left; and a correction for common terms, found on the terms' postings. Of a term's
    postings no pair becomes a row: a task adds them up by pair of groups. A language may have 2^26 groups, and a task 2^11
    languages.
    """
    common = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p", "p0")).alias("x")).select("lang", "x")
    shared = common.mapInArrow(_shared, "lang string, g int, h int, value long")
    other = stats.where("v > 0").select("lang", F.col("place").alias("h"), F.col("p0").alias("q0"))
    counts = postings.groupBy("lang", "place", "p", "p0").agg(F.count("*").alias("n"))
    faced = counts.join(other, "lang").where("place <> h")
    ways = F.array(
        F.struct(F.col("place").alias("g"), "h", (F.col("n") * _f(F.col("p"), F.col("q0"))).alias("value")),
        F.struct(F.col("h").alias("g"), F.col("place").alias("h"), (F.col("n") * _f(F.col("q0"), F.col("p"))).alias("value")),
    )
    alone = faced.select("lang", F.explode(ways).alias("w")).select("lang", "w.g", "w.h", "w.value")
    sums = shared.unionByName(alone).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    one = stats.select("lang", "source", F.col("place").alias("g"), "m", "v", "p0")
    two = stats.select("lang", F.col("source").alias("item"), F.col("place").alias("h"), F.col("m").alias("m2"), F.col("p0").alias("q0"))
    pairs = one.join(two, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left")
    rest = F.when(F.col("v") > 0, (F.col("v") - F.col("m") - F.col("m2")) * _f(F.col("p0"), F.col("q0"))).otherwise(0)
    return pairs.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest).alias("value"))


def audit(docs: DataFrame, k: int = 200, least_docs: int = 3, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: the k terms in which a group exceeds its language most, and its distance to each sister group.

    Nulls in any column are read as ''; a group without kept terms has pairs and no terms; a language without kept terms has
    pairs of value 0. Equal values go by the item's bytes. Repeated rows are documents of their own, texts are read whole,
    an empty table gives no rows, other columns are not read. All arithmetic is in whole numbers.
    """
    counts = durable(counted(docs, lang, source, text))
    terms = durable(kept_terms(counts, least_docs))
    stats = durable(group_stats(counts, terms))
    postings = durable(judged_postings(terms, stats))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_sums(postings, stats).withColumn("rank", ranked).withColumn("part", F.lit("pair"))
    found = top_terms(postings, k).withColumn("part", F.lit("term")).unionByName(pairs)
    return found.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
