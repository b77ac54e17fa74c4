"""Derived states and JSON fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def availability(playable: Column, market: Column) -> Column:
    return F.when(playable.isNull(), market).when(playable, "available").otherwise("unavailable")


def market_status(known: Column, restrictions: Column, playable: Column) -> Column:
    """No document: missing; any restriction or not playable: unavailable; playable: available; else unknown."""
    return F.when(~known, "missing").when(F.coalesce(restrictions, F.lit("")) != "", "unavailable").when(playable.isNull(), "unknown").when(playable, "available").otherwise("unavailable")


def null_reason(item_known: Column, track_known: Column, local: Column, kind: Column, id_: Column) -> Column:
    """Why a playlist item has no track, null if it has one; the first that holds."""
    return F.when(~item_known, "unknown").when(~track_known, "unavailable").when(local, "local").when(kind == "episode", "episode").when(F.coalesce(id_, F.lit("")) == "", "unavailable")


def local_analysis(low_level: Column, advanced: Column) -> Column:
    """A failed low-level analysis before success of both, partial of either, missing."""
    ok = [F.coalesce(c.isin("success", "partial"), F.lit(False)) for c in (low_level, advanced)]
    return F.when(low_level == "failed", "failed").when(ok[0] & ok[1], "success").when(ok[0] | ok[1], "partial").otherwise("missing")


def job_label(status: Column) -> Column:
    return F.when(status == "queued", "pending").when(status == "succeeded", "success").otherwise(status)


def audit_verdict(isrc_unresolvable: Column, mismatch: Column, fuzzy: Column, confidence: Column, least: float = 0.60) -> Column:
    return F.when(isrc_unresolvable, "isrc_unresolvable").when(mismatch, "mismatch").when(fuzzy & (confidence < least), "low_confidence_fuzzy").otherwise("ok")


def json_number(document: Column, path: str) -> Column:
    """A number at a path; null for malformed documents, other types and absent paths."""
    return F.get_json_object(document, path).try_cast("double")


def cover_image(images: Column) -> Column:
    """The narrowest image of 64..300 pixels, else the narrowest of positive width, else the first. images: array of struct(width, url)."""
    def narrowest(low: int, high: int) -> Column:
        some = F.filter(images, lambda i: i["width"].between(low, high))
        return F.when(F.size(some) > 0, F.array_sort(some)[0]["url"])

    return F.coalesce(narrowest(64, 300), narrowest(1, 1 << 30), F.when(F.size(images) > 0, images[0]["url"]))
