"""The best match of every track against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from crateflow.operators import matching
from crateflow.plans import catalogue

DIR = "/root/testdata/sf0.01"


def all_pairs(t):
    seconds = F.col("duration_ms") / 1000
    mine = t.select("track_id", "grp", "title", F.lit("a").alias("artist"), seconds.alias("duration_s"), "isrc")
    other = t.select(F.col("track_id").alias("ordinal"), "grp", F.col("title").alias("c_title"), F.lit("a").alias("c_artist"), seconds.alias("c_duration_s"), F.col("isrc").alias("c_isrc"), F.lit("u").alias("url"))
    return matching.best(matching.scored(mine.join(other, "grp").where("track_id <> ordinal")))


def found(df):
    return sorted((r.track_id, r.ordinal, r.score, r.isrc_exact, r.status) for r in df.collect())


@pytest.mark.parametrize("spread", [50, 40_000, 900_000])
def test_best_in_group_equals_all_pairs(spark, spread):
    rnd = random.Random(spread)
    titles = ["song", "Song", "live", "tune", "karaoke", "remix", "", None, "söng"]
    rows = [(k, rnd.choice(["x", "y", "z", None]), rnd.choice(titles), rnd.choice([None, 0, *[200_000 + rnd.randint(-spread, spread) for _ in range(18)]]), rnd.choice([None, "", f"i{rnd.randint(0, 150)}", f" I{rnd.randint(0, 150)}"])) for k in range(400)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, (900, "alone", "song", 1, "i1")], "track_id long, grp string, title string, duration_ms long, isrc string")
    assert found(matching.best_in_group(df)) == found(all_pairs(df))


def test_every_track_with_a_candidate_has_a_row(spark):
    title = F.regexp_replace("normalized_title", r"[^\p{L}\p{N}]", "")
    t = catalogue.Library(spark, DIR)["tracks"].select("track_id", F.col("album_id").alias("grp"), title.alias("title"), "duration_ms", "isrc")
    got = sorted((r.track_id, r.candidate_id, r.score) for r in catalogue.QUERIES["preview_best_match_all"](spark, DIR).collect())
    assert got == sorted((r.track_id, r.ordinal, r.score) for r in all_pairs(t).collect())
    assert {r[0] % 5 for r in got} == set(range(5))
