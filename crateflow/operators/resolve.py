"""One value per track and feature from several sources, with confidence, source and status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions.numeric import or_default, valid_field

LOW_CONFIDENCE = 0.5
#: How a long-form row's status ranks.
STATUS_RANK = {"success": 3, "partial": 2, "model_missing": 1}


def status_rank(status: Column) -> Column:
    found = F.lit(0)
    for name, rank in STATUS_RANK.items():
        found = F.when(status == name, rank).otherwise(found)
    return found


def newest_per_source(rows: DataFrame) -> DataFrame:
    """The newest row of each track and source: fetched_at (nulls last), then the largest id."""
    first = F.row_number().over(Window.partitionBy("track_id", "source").orderBy(F.desc_nulls_last("fetched_at"), F.desc("row_id")))
    return rows.withColumn("n", first).where("n = 1").drop("n")


def best_status(rows: DataFrame) -> DataFrame:
    """Per track and feature the row of the best status; of equal ones the one with the largest id."""
    first = F.row_number().over(Window.partitionBy("track_id", "feature").orderBy(F.desc(status_rank(F.col("status"))), F.desc("row_id")))
    return rows.withColumn("n", first).where("n = 1").drop("n")


def first_usable_embedding(rows: DataFrame) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("track_id").orderBy("row_id"))
    return rows.where(F.col("status").isin("success", "partial")).withColumn("n", best).where("n = 1").drop("n")


def merge_winner(rows: DataFrame) -> DataFrame:
    """rows with is_winner: the highest-priority success or partial row of each track (ties: the smallest id)."""
    usable = F.col("status").isin("success", "partial")
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(usable.desc(), F.desc("priority"), "row_id"))
    return rows.withColumn("is_winner", usable & (rank == 1))


def by_priority(rows: DataFrame, field: str, sources: Sequence[str], confidence: str | None = None) -> DataFrame:
    """track_id, value, confidence, source, status of one field: the first source of the list that has a value.

    rows: one per track and source. Any row counts, whatever its status. An invalid value is missing, a confidence of 0
    or null counts 1, and below LOW_CONFIDENCE the value is of low confidence.
    """
    held = F.col(field).cast("double")
    sure = or_default(F.col(confidence), 1.0) if confidence else F.lit(1.0)
    per = rows.groupBy("track_id").agg(*[F.max_by(F.struct(held.alias("v"), sure.alias("c"), F.lit(s).alias("s")), F.when((F.col("source") == s) & held.isNotNull(), F.col("row_id"))).alias(f"s{k}") for k, s in enumerate(sources)])
    picked = per.select("track_id", F.coalesce(*[F.col(f"s{k}") for k in range(len(sources))]).alias("p"))
    value = valid_field(field, F.col("p.v"))
    status = F.when(value.isNull(), "missing").when(F.col("p.c") < LOW_CONFIDENCE, "low_confidence").otherwise("available")
    return picked.select("track_id", F.lit(field).alias("feature"), value.alias("value"), F.when(value.isNotNull(), F.col("p.c")).alias("confidence"), F.when(value.isNotNull(), F.col("p.s")).alias("source"), status.alias("status"))


def wide_by_priority(rows: DataFrame, fields: Sequence[str], sources: Sequence[str], confidence: str) -> DataFrame:
    """by_priority() of several fields as structs (value, confidence, source, status), from one grouping of the rows."""
    sure = or_default(F.col(confidence), 1.0)
    held = {f: F.col(f).cast("double") for f in fields}
    best = [F.max_by(F.struct(held[f].alias("v"), sure.alias("c"), F.lit(s).alias("s")), F.when((F.col("source") == s) & held[f].isNotNull(), F.col("row_id"))).alias(f"{f}_{k}") for f in fields for k, s in enumerate(sources)]
    per = rows.groupBy("track_id").agg(*best)
    picked = per.select("track_id", *[F.coalesce(*[F.col(f"{f}_{k}") for k in range(len(sources))]).alias(f) for f in fields])
    out = []
    for f in fields:
        value = valid_field(f, F.col(f"{f}.v"))
        status = F.when(value.isNull(), "missing").when(F.col(f"{f}.c") < LOW_CONFIDENCE, "low_confidence").otherwise("available")
        out.append(F.struct(value.alias("value"), F.when(value.isNotNull(), F.col(f"{f}.c")).alias("confidence"), F.when(value.isNotNull(), F.col(f"{f}.s")).alias("source"), status.alias("status")).alias(f))
    return picked.select("track_id", *out)


def long_form_status(row_status: Column, value: Column, confidence: Column) -> Column:
    return F.when(row_status == "model_missing", "model_missing").when(value.isNull(), "missing").when((row_status == "partial") | (confidence < LOW_CONFIDENCE), "low_confidence").otherwise("available")


def with_fallback(resolved: DataFrame, local: DataFrame, fallback: Mapping[str, str]) -> DataFrame:
    """resolved with features that are not available replaced by the local feature of the mapping, where that has a value.

    `valence_inverse` is added before that, from the value as first resolved, and is available whenever there is one.
    """
    inverse = resolved.where((F.col("feature") == "valence") & F.col("value").isNotNull())
    inverse = inverse.select("track_id", F.lit("valence_inverse").alias("feature"), (1 - F.col("value")).alias("value"), "confidence", "source", F.lit("available").alias("status"))
    name = F.lit(None).cast("string")
    for to, of in fallback.items():
        name = F.when(F.col("feature") == to, of).otherwise(name)
    other = local.where(F.col("value").isNotNull()).select(F.col("track_id").alias("t"), F.col("feature").alias("f"), F.col("value").alias("lv"), F.col("confidence").alias("lc"), F.col("status").alias("ls"))
    rows = resolved.withColumn("local_name", name).join(other, (F.col("track_id") == F.col("t")) & (F.col("local_name") == F.col("f")), "left")
    use = (F.col("status") != "available") & F.col("lv").isNotNull()
    pick = lambda a, b: F.when(use, b).otherwise(F.col(a)).alias(a)
    merged = rows.select("track_id", "feature", pick("value", F.col("lv")), pick("confidence", F.col("lc")), pick("source", F.lit("local")), pick("status", long_form_status(F.col("ls"), F.col("lv"), F.col("lc"))))
    return merged.unionByName(inverse)


#: Fixed value: features of later phases than this are to come.
LAST_PHASE = 6


def unresolved(wanted: DataFrame, phases: Mapping[str, int], resolved: DataFrame) -> DataFrame:
    """track_id, feature, status of wanted features (track_id, feature) that nothing resolved: not_available_yet for those of a later phase, else missing."""
    phase = F.lit(None).cast("int")
    for name, n in phases.items():
        phase = F.when(F.col("feature") == name, n).otherwise(phase)
    rows = wanted.join(resolved.select("track_id", "feature"), ["track_id", "feature"], "left_anti")
    return rows.select("track_id", "feature", F.when(phase > LAST_PHASE, "not_available_yet").otherwise("missing").alias("status"))


def timbre(vector: Column, size: int = 256) -> Column:
    return F.slice(vector, 1, size)
