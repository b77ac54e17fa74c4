import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crateflow.llm import jaccard_join as J
from crateflow.llm.components import components

from .oracle import same


def brute_set(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in (text or "").encode().decode().replace("\x0b", " ").split()]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """{row number: (class_id, n_links, kept)}"""
    sets = [brute_set(t) for _, t in rows]
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                link[i][j] = link[j][i] = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i]] + [label[j] for j in range(n) if link[i][j]]) for i in range(n)]
        if new == label:
            break
        label = new
    least = {c: min(rows[i][0] for i in range(n) if label[i] == c) for c in set(label)}
    return sorted((rows[i][0], least[label[i]], sum(link[i]), rows[i][0] == least[label[i]]) for i in range(n))


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows = []
    for base in range(12):
        words = [word() for _ in range(rnd.choice([3, 20, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            rows += [" ".join(copy)] * rnd.choice([1, 1, 2])
    rows += ["", "  \n", "one", "One", "a b c d", "a b c d e", "é É", "x " * 5000, "x " * 6]
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows] + [(1000, None, "c")], "doc_id long, text string, mark string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in J.near_copies(df).collect())
    assert got == brute(rows + [(1000, None)])


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_CLASSES", 3)
    rows = corpus()
    got = sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in J.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_products_give_the_intersections():
    rng = np.random.default_rng(0)
    blocks = [[(k, 1, np.unique(rng.integers(0, 6000, rng.integers(1, 5000)).astype(np.uint64)), None) for k in range(5)] for _ in range(2)]
    want = [[len(np.intersect1d(x[2], y[2])) for y in blocks[1]] for x in blocks[0]]
    assert J._common(*blocks).tolist() == want


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_copies(df).count() == 0 and J.keep_one(df).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "q r s"), (5, "q r s")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_links) for r in J.near_copies(df).collect()) == [(-1, 1), (-1, 1), (5, 1), (5, 1)]
    assert J.keep_one(df).count() == 4


def test_components(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, k) for k in range(201, 260)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(70)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(root[u], root[v])
            if root[u] != m or root[v] != m:
                root[u] = root[v] = m
                changed = True
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {x for x in root if all(u == v for u, v in edges if x in (u, v))}
    assert got == {x: c for x, c in root.items() if x not in alone}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_band_count():
    n = J.bands_for(0.8, 8, 0.9998)
    assert 1 - (1 - 0.8**8) ** n >= 0.9998 > 1 - (1 - 0.8**8) ** (n - 1)


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [x[0] for x in brute(rows) if x[3]]


def test_against_sql(spark):
    queries = pytest.importorskip("crateflow.llm.queries")
    assert same(spark, "op6_jaccard_join", queries.QUERIES, queries.ORACLES) == 1000


def test_a_null_id_in_a_class_keeps_its_links(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (1, "  ".join(words)), (2, " ".join([*words[:-1], "other"]))]
    got = {r.doc_id: (r.class_id, r.text_class, r.n_links, r.kept) for r in J.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: (1, 1, 2, False), 1: (1, 1, 2, True), 2: (1, 2, 2, False)}


def test_one_row_of_each_class(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash")).withColumn("row", F.lit("clash"))
    kept = J.keep_one_row(df.unionByName(df.where("length(text) > 3")))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [x[0] for x in brute(rows) if x[3]]
    rows = [(1, "a b c"), (1, "a b c"), (1, "A  b c"), (2, "a b c"), (None, "d e f"), (None, "D e f"), (None, "g h i"), (3, ""), (3, ""), (None, None)]
    got = J.keep_one_row(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower().split()) for r in got) == sorted([(1, ["a", "b", "c"]), (0, ["d", "e", "f"]), (0, ["g", "h", "i"]), (3, []), (3, []), (0, [])])
    assert J.keep_one_row(df.limit(0)).count() == 0


def test_a_chain_is_verified_by_its_buckets(spark, monkeypatch):
    """A component of many look-alikes: every set goes to its buckets, not to every block of the component."""
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(120):  # neighbours are near copies, the ends have nothing in common
        words[rnd.randrange(len(words))] = f"n{k}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(J, "BLOCK_CLASSES", 8)
    shipped = []
    verify = J._verify

    def counted(dealt, threshold):
        shipped.append(dealt.count())
        return verify(dealt, threshold)

    monkeypatch.setattr(J, "_verify", counted)
    got = sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in J.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    assert shipped[0] <= 120 * J.bands_for()


def test_each_pair_has_one_bucket():
    """Of the buckets that two classes share, the smallest verifies them; a whole component takes all of its buckets."""
    left, right = [(0, 1, None, [3, 5]), (1, 1, None, [5])], [(2, 1, None, [3, 5]), (3, 1, None, [5, 9])]
    assert J._candidates(left, right, 5, False).tolist() == [[False, True], [True, True]]
    assert J._candidates(left, right, 3, False)[:1, :1].tolist() == [[True]]
    assert J._candidates([(0, 1, None, [1])], right, 0, True).tolist() == [[False, False]]
    assert J._candidates(left, right, 0, True).tolist() == [[True, True], [True, True]]


def test_keep_one_carries_any_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(2, text, "m", "d"), (1, text, "m", "d"), (3, "other words in this text here now", "m", "d")], "doc_id long, text string, __i string, `a.b` string")
    got = J.keep_one(rows)
    assert got.columns == rows.columns and sorted(tuple(r)[0] for r in got.collect()) == [1, 3]


def test_what_has_no_bound_is_merged_even_if_small(spark, monkeypatch, capsys):
    plans, write = {}, J.write_table

    def noted(df):
        capsys.readouterr()
        df.explain()
        plans[tuple(df.columns)] = capsys.readouterr().out
        return write(df)

    monkeypatch.setattr(J, "write_table", noted)
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in J.near_copies(df).collect()) == brute(corpus())
    for table in (("cls", "bucket", "head"), ("cls", "links", "texts", "root")):
        assert "SortMergeJoin" in plans[table] and "BroadcastHashJoin" not in plans[table]


def test_idle_workers_hold_no_words(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4)
    J.signatures(df.selectExpr("doc_id as id", "doc_id as mark", "text"), 2, 2, 5).collect()

    def held(batches):
        for batch in batches:
            time.sleep(0.3)
            yield pa.RecordBatch.from_arrays([pa.array([len(J._HASHES)] * len(batch), pa.int64())], ["n"])

    assert {r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()} == {0}
