import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from crateflow.operators import ranking, search, upserts
from crateflow.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_quantiles_of_hot_groups_and_values(spark):
    """One group with half of all rows, one value with a third, nulls in both columns, in many more tasks than groups."""
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([5.0, None, round(rnd.random() * 100, 2), round(rnd.random() * 100, 2)])) for _ in range(3000)]
    df = spark.createDataFrame([*rows, (9, None)], "g long, v double")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {r.g: r.median for r in ranking.medians(df, ["g"], "v").collect()}
        p95 = {r.g: r.p95 for r in ranking.p95s(df, ["g"], "v").collect()}
        whole = ranking.medians(df, [], "v").first().median
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {g: sorted(v for k, v in rows if k == g and v is not None) for g in (1, 2, 3, None)}
    assert got == {g: statistics.median(v) for g, v in groups.items()}
    assert p95 == {g: v[max(0, int(len(v) * 0.95) - 1)] for g, v in groups.items()}
    assert whole == statistics.median([v for _, v in rows if v is not None])
    assert got == {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).where("m is not null").collect()}
    assert ranking.medians(df.limit(0), ["g"], "v").count() == 0


@pytest.mark.parametrize("facets", [{"sort": "title"}, {"sort": "popularity", "descending": True}, {"sort": "isrc"}, {"sort": "isrc", "descending": True}, {"sort": "added_at", "descending": True}, {"sort": "duration", "title": "a"}])
def test_deep_pages_equal_offsets(spark, monkeypatch, facets):
    """Null keys, ties, both directions; first, middle, last and missing pages."""
    monkeypatch.setattr(search, "RANGES", 7)
    monkeypatch.setattr(search, "SAMPLES", 4)
    lib = catalogue.Library(spark, DIR)
    for number in (1, 4, 11, 99):
        spec = search.SearchSpec(**facets, page=number, page_size=17)
        assert sorted(map(tuple, search.deep_page_ids(lib, spec).collect())) == sorted(map(tuple, search.page_ids(lib, spec).collect())), number


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_only_what_changed(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(k, None if k % 7 == 0 else f"p{k % 3}", f"v{k}") for k in range(200)]
    kind = "id long, part string, v string"
    upserts.write_bucketed(spark.createDataFrame(rows, kind), path, ["id", "part"], 16)
    before = files(path)
    changes = spark.createDataFrame([(0, None, "new"), (500, "x", "added")], kind)
    touched = upserts.merge_changed(spark, path, changes, ["id", "part"], 16)
    after = files(path)
    assert len(touched) <= 2 and {f for f in before if not any(f"bucket={b}/" in f for b in touched)} == before & after
    want = {(i, p): v for i, p, v in rows} | {(0, None): "new", (500, "x"): "added"}
    assert {(r.id, r.part): r.v for r in upserts.read_bucketed(spark, path).collect()} == want
    assert upserts.merge_changed(spark, path, changes.limit(0), ["id", "part"], 16) == []
    upserts.merge_changed(spark, path, spark.createDataFrame([(0, None, "again"), (501, "x", "more")], kind), ["id", "part"], 16, insert_only=True)
    assert {(r.id, r.part): r.v for r in upserts.read_bucketed(spark, path).collect()} == want | {(501, "x"): "more"}


def test_a_failed_merge_leaves_the_table(spark, tmp_path):
    path, kind = f"{tmp_path}/t", "id long, v string"
    upserts.write_bucketed(spark.createDataFrame([(k, "old") for k in range(50)], kind), path, ["id"], 8)
    before = files(path)
    broken = spark.range(20).select("id", F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        upserts.merge_changed(spark, path, broken, ["id"], 8)
    assert before <= files(path) and {r.v for r in upserts.read_bucketed(spark, path).collect()} == {"old"}
