"""Top-k search and embedding near-dedup against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateflow.llm import embedding_dedup as E
from crateflow.llm import queries
from crateflow.llm import topk_search as T

from .oracle import same

NAN = float("nan")


@pytest.mark.parametrize("name, rows", [("op4_topk_search", None), ("op8_embedding_dedup", 500)])
def test_against_sql(spark, name, rows):
    assert same(spark, name, queries.QUERIES, queries.ORACLES) == (rows or 500 // 20 * 20)


def brute_top(vectors, ask, k):
    out = []
    for q in ask:
        scores = sorted(((-int(vectors[q] @ vectors[c]), c) for c in range(len(vectors)) if c != q))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


def test_search_in_pieces(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 7), ("SHARD", 40), ("PIECE", 16), ("RUN", 2)):
        monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(150, 6)), rng.integers(-1, 2, (60, 6))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 9 == 0, 5).collect())
    assert got == brute_top(np.floor(64 * v).astype(int), range(0, len(v), 9), 5)


def test_maxscore_skips():
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.normal(size=(4000, 32)) * np.linspace(1, 0.02, 32))

    block = T.Block(np.arange(10), x[:10], 5)
    for lo in range(0, 4000, 500):
        block.meet(np.arange(lo, lo + 500), x[lo : lo + 500])
    assert block.probed < 0.4 * 40_000
    got = sorted((int(block.at[n]), int(block.cand[n]), int(block.score[n])) for n in range(len(block.at)))
    assert got == sorted((q, c, s) for q, _, c, s in brute_top(x.astype(int), range(10), 5))


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [NAN, 1.0]), (3, [1.0, None]), (4, [math.inf, 0.0]), (5, [1.0]), (5, [1.0]), (20, [0.0, 0.0]), (None, [1.0, 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 5, 4096), (0, 2, 6, 0), (0, 3, 20, 0), (20, 1, 0, 0), (20, 2, 5, 0), (20, 3, 6, 0)]
    assert T.top_k(df.limit(0), F.lit(True)).count() == 0


def brute_links(rows, threshold=0.98):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    link = [[i != j and units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold for j in range(len(rows))] for i in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i]] + [label[j] for j in range(len(rows)) if link[i][j]]) for i in range(len(rows))]
    least = {c: min(rows[i][0] for i in range(len(rows)) if label[i] == c) for c in set(label)}
    return sorted((rows[i][0], sum(link[i]), least[label[i]], rows[i][0] == least[label[i]]) for i in range(len(rows)))


def clusters(seed=3, n=40):
    rng, rows = np.random.default_rng(seed), []
    for c in range(n):
        center = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((center + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.16])).tolist())
    return [(i, v, int(i % 3) if i % 10 else None) for i, v in enumerate(rows)]


def test_dedup_finds_the_links(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 8)
    rows = clusters()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in E.near_duplicates(df, leaf_size=20).collect())
    assert got == brute_links(rows)


def test_dedup_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (5, [0.0, 0.0], 1), (6, [NAN, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (9, [1e-200, 0.0], 1), (10, [-1.0, 0.0], 1), (11, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    assert got == sorted([(0, 3, 0, True), (1, 3, 0, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 3, 0, False), (10, 0, 10, True), (11, 3, 0, False)])
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_dedup_on_more_vectors(spark):
    assert same(spark, "op8_embedding_dedup", queries.QUERIES, queries.ORACLES, "/root/testdata/sf0.1") == 2000


def test_search_skips_shards_and_postings():
    """Queries near one of several far apart groups traverse few postings of the others' pieces."""
    rng = np.random.default_rng(5)
    centers = 60 * np.eye(16)[:8]
    x = np.floor(np.concatenate([c + rng.normal(size=(256, 16)) for c in centers]))
    block = T.Block(np.arange(20), x[:20], 5)
    for lo in range(0, len(x), 256):
        block.meet(np.arange(lo, lo + 256), x[lo : lo + 256])
    assert block.traversed <= 20 * 256 * 16 and block.probed <= 20 * 256  # the first group alone
    got = sorted((int(block.at[n]), int(block.cand[n]), int(block.score[n])) for n in range(len(block.at)))
    assert got == sorted((q, c, s) for q, _, c, s in brute_top(x.astype(int), range(20), 5))


def test_scores_beyond_the_whole_numbers_of_doubles(spark, monkeypatch):
    """Components near 2^28 in four dimensions; candidates whose scores are one apart; shards and pieces that bounds skip."""
    for name, value in (("SHARD", 64), ("PIECE", 16), ("RUN", 2)):
        monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(3)
    v = rng.integers(-(1 << 28), 1 << 28, (300, 4))
    v[100:200] = v[0] + rng.integers(0, 2, (100, 4))
    v[200:] = v[200:] // (1 << 20)
    exact = v.astype(object)
    df = spark.createDataFrame([(i, [float(c) / 64 for c in x]) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 20 == 0, 7).collect())
    assert got == brute_top(exact, range(0, 300, 20), 7) and max(abs(r[3]) for r in got) > 1 << 54
    block = T.Block(np.array([0]), np.array([[1 << 32, 1 << 32]]), 3)
    with pytest.raises(OverflowError):
        block.meet(np.array([1]), np.array([[1 << 32, 1 << 32]]))
