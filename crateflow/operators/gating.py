"""Which models run on a segment, what a segment lacks, and responses of a feature service as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.functions.numeric import FIELD_RANGES, match_confidence, row_confidence, valid_field

#: Codes of a service's answers that have no features.
NOT_FOUND, NO_FEATURES = "RECCOBEATS_NOT_FOUND", "RECCOBEATS_FEATURES_MISSING"


def gated(models: DataFrame, profile: DataFrame, present: DataFrame) -> DataFrame:
    """(model, state) of the models whose extractor and head are both in the profile: run if both are present, else models_missing.

    models: model, extractor, head; profile and present: name.
    """
    def both(rows: DataFrame, names: DataFrame) -> DataFrame:
        for part in ("extractor", "head"):
            rows = rows.join(names.select(F.col("name").alias(part)).distinct(), part, "left_semi")
        return rows

    wanted = both(models, profile)
    able = both(wanted, present).select("model", F.lit("run").alias("state"))
    return wanted.select("model").distinct().join(able.distinct(), "model", "left").select("model", F.coalesce("state", F.lit("models_missing")).alias("state"))


def missing_models(lists: list[Column], genre: Column, top_labels: Column) -> Column:
    """The union of the lists of missing models, less the genre model if its top labels are there after all."""
    union = F.array().cast("array<string>")
    for names in lists:
        union = F.array_union(union, F.coalesce(names, F.array().cast("array<string>")))
    return F.when(F.coalesce(F.size(top_labels), F.lit(0)) > 0, F.array_except(union, F.array(genre))).otherwise(union)


def failure_code(status: Column, default: str) -> Column:
    """The code of a failure that has none: the status where a model is missing."""
    return F.when(status == "model_missing", status).otherwise(F.lit(default))


def mapped(responses: DataFrame) -> DataFrame:
    """A feature row per response: the valid fields, feature_confidence, status, external_track_id and error_code.

    responses: track_id, isrc and the service's track (struct of id, isrc, duration_ms) and features (struct of tempo and
    the fields), either null if not found. A duration of 0 or null is the track's. Fields count with the confidence
    of the match, which is by ISRC where both agree.
    """
    have = F.col("track").isNotNull() & F.col("features").isNotNull()
    named = {f: F.col(f"features.{'tempo' if f == 'bpm' else f}") for f in FIELD_RANGES}
    named["duration_ms"] = F.coalesce(F.nullif(named["duration_ms"], F.lit(0)), F.col("track.duration_ms"))
    same = F.coalesce((F.upper("isrc") == F.upper("track.isrc")) & (F.col("isrc") != ""), F.lit(False))
    confidence, status = row_confidence(named, match_confidence(F.when(same, "isrc").otherwise("id")))
    code = F.when(F.col("track").isNull(), NOT_FOUND).when(F.col("features").isNull(), NO_FEATURES)
    return responses.select(
        "track_id", *[F.when(have, valid_field(f, c)).alias(f) for f, c in named.items()], F.when(have, confidence).alias("feature_confidence"),
        F.when(have, status).otherwise("not_found").alias("status"), F.col("track.id").alias("external_track_id"), code.alias("error_code"),
    )
