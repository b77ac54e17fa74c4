import hashlib
import math
import zlib

from pyspark.sql import functions as F

from crateflow.llm import queries, sharding
from crateflow.llm.numbering import numbered
from crateflow.llm.runtime import durable
from tests.llm.oracle import same

SCHEMA = "doc_id long, text string, slot string, shard string"


def descend(key, tree):
    node = 0
    for level in tree.levels():
        def draw(c):
            h = int(hashlib.md5(f"{c[0]}:{key}".encode()).hexdigest()[:13], 16)
            return -math.log((h + 0.5) / 16**13) / c[1]

        node = min((draw(c), c[2]) for c in level[node])[1]
    return node


def shards(spark, tree, n=4000):
    rows = spark.range(n).select(sharding.drawn(F.col("id").cast("string"), tree).alias("s"), "id").collect()
    return {r["id"]: r["s"] for r in rows}


def test_sql(spark):
    assert same(spark, "op12_sharding", queries.QUERIES, queries.ORACLES) == 1000


def test_edges(spark):
    """Nulls, empty, long and equal texts, repeated rows and ids, clashing names: each row once, slots without gaps."""
    docs = [(k, f"text é {k}") for k in range(300)] + [(None, "x"), (None, None), (5, ""), (5, ""), (7, "long " * 50_000)] + [(1000 + k, "equal") for k in range(40)]
    tree = sharding.regular(6, 2, 2)
    got = sharding.placed(spark.createDataFrame([(i, t, "mine", "own") for i, t in docs], SCHEMA).repartition(3), tree, carry=["slot", "shard"]).collect()
    want = sorted((("" if i is None else str(i)), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), descend("" if i is None else i, tree), descend("" if i is None else i, tree.grown())) for i, t in docs)
    assert sorted(("" if r["doc_id"] is None else str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    assert all(r["carried"] == ("mine", "own") and r["law"] == "key" for r in got)
    for s in {r["shard"] for r in got}:
        mine = sorted((r["slot"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["shard"] == s)
        assert [x[0] for x in mine] == list(range(len(mine))) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
    assert sharding.placed(spark.createDataFrame([], SCHEMA), tree).count() == 0


def test_growth_takes_rows_only_into_the_new_shard(spark):
    tree = sharding.regular(40)
    before = shards(spark, tree)
    for _ in range(3):
        n, tree = len(tree.shards), tree.grown()
        after = shards(spark, tree)
        moved = {k for k in after if after[k] != before[k]}
        assert moved and all(after[k] == n for k in moved) and len(moved) < 3 * len(after) / n
        before = after
    sizes = [list(before.values()).count(s) for s in range(43)]
    assert max(sizes) < 2 * min(sizes)


def test_changed_weights_move_rows_within_their_subtree(spark):
    """Weight from one shard to another of a rack: only that rack's rows move; a heavier region only wins rows, a dead shard has none."""
    tree = sharding.regular(16, 4, 2)
    before = shards(spark, tree)

    def weighed(new):
        return sharding.Tree(tuple(s._replace(weight=new.get(s.shard, s.weight)) for s in tree.shards))

    after = shards(spark, weighed({0: 0.5, 1: 1.5}))
    assert all({before[k], after[k]} <= {0, 1, 2, 3} for k in after if after[k] != before[k])
    assert all(before[k] != 1 or after[k] == 1 for k in after)
    heavier = shards(spark, weighed({12: 3.0}))
    assert all(heavier[k] >= 8 for k in heavier if before[k] >= 8)
    dead = shards(spark, weighed({3: 0.0}))
    assert 3 not in dead.values() and {before[k] for k in dead if before[k] // 4 == 0 and dead[k] // 4 == 0} <= {0, 1, 2, 3}


def test_files_follow_the_slots(spark, tmp_path):
    rows = sharding.placed(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), sharding.regular(4, 2, 1))
    sharding.write_shards(rows, f"{tmp_path}/out", 50)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500 and {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"shard={s}" for s in range(4)}


def test_numbers_of_one_hot_group(spark):
    """A third of all rows equal in every column, many partitions: still each number once."""
    rows = durable(spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"), (F.col("id") % 2).alias("g")))
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = numbered(rows, [F.asc_nulls_last("v")], "n", by="g").collect()
        whole = numbered(rows, [F.asc_nulls_last("v")], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r["g"], r["n"]) for r in got) == [(g, n) for g in (0, 1) for n in range(1500)]
    assert sorted(r["n"] for r in whole) == list(range(3000)) and all(r["n"] >= 2000 for r in whole if r["v"] is None)
