"""Playlist rules: candidates, filters with reasons, renormalised scores, diversity and order.

A rule is a dictionary as its document has it. It is checked and compiled on the driver; candidates to scores run as one plan
over all tracks. Features come as columns of a wide view: <name>, <name>_status.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions.numeric import clamp01, min_max
from crateflow.sources.tables import written

MOST_TRACKS = 500
#: Reason codes of range failures. Features without their own report one of two others.
RANGE_REASONS = {
    "bpm": "BPM_OUT_OF_RANGE", "energy": "ENERGY_OUT_OF_RANGE", "valence": "VALENCE_OUT_OF_RANGE", "danceability": "DANCEABILITY_OUT_OF_RANGE",
    "loudness": "DANCEABILITY_OUT_OF_RANGE", "feature_confidence": "FEATURE_LOW_CONFIDENCE",
}
OTHER_RANGE = "BPM_OUT_OF_RANGE"


#: Components that are constants, and those that depend on a boolean column (value if true, if not).
DERIVED = {"playlist_fit_score": 0.5, "diversity_bonus": 0.1}
DERIVED_BY = {"freshness_score": ("liked", 0.5, 0.3), "preview_bonus": ("preview_available", 0.05, 0.0)}
#: Other names of features.
ALIASES = {
    "tempo": "bpm", "genre_discogs519": "genre_discogs_519", "mood_electronic": "electronic_profile_score", "mood_acoustic": "acoustic_profile_score",
    "acoustic": "acoustic_profile_score", "instrumental": "instrumental_focus_score", "valence_local": "valence_tf", "danceability_local": "danceability_tf",
}

#: Orders that are named but not offered, ways to bring a playlist up to date, options that are accepted and not used.
FUTURE_ORDERINGS = ("energy_curve_progressive", "warmup_peak_cooldown", "harmonic_flow", "cluster_walk", "embedding_similarity_path")
SYNC_MODES = ("create", "replace", "add_only", "remove_obsolete", "replace_after_dry_run")
UNUSED = ("missing_component_behavior", "unavailable_behavior", "exclude_tags")


@dataclass(frozen=True)
class FeatureFilter:
    feature: str
    low: float | None = None
    high: float | None = None
    required: bool = False


@dataclass(frozen=True)
class Rule:
    liked: bool = False
    playlists: Sequence[int] = ()
    track_ids: Sequence[int] = ()
    exclude_playlists: Sequence[int] = ()
    exclude_track_ids: Sequence[int] = ()
    filters: Sequence[FeatureFilter] = ()
    availability: Sequence[str] = ()
    market: Sequence[str] = ()
    exclude_artists: Sequence[int] = ()
    exclude_albums: Sequence[str] = ()
    weights: Mapping[str, float] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    max_per_artist: int | None = None
    max_per_album: int | None = None
    target_size: int = 50
    spread_artists: bool = False
    ordering: str = "score_desc"
    seed: int = 42
    sync_mode: str = "create"
    seed_tracks: Sequence[int] = ()
    clusters: Sequence[str] = ()
    cluster_diversity: bool = False
    vocal_balance: bool = False


def parse(document: Mapping[str, Any]) -> Rule:
    """A rule from its document; unknown keys fail, UNUSED ones are ignored, other names of features become their own."""
    document = {k: v for k, v in document.items() if k not in UNUSED}
    filters = [FeatureFilter(**{**f, "feature": ALIASES.get(f["feature"], f["feature"])}) for f in document.get("filters", ())]
    return Rule(**{**document, "filters": filters, "weights": {ALIASES.get(k, k): v for k, v in document.get("weights", {}).items()}})


def override(document: Mapping[str, Any], changes: Mapping[str, Any]) -> dict[str, Any]:
    return {**document, **changes}


def problems(rule: Rule, known: Sequence[str]) -> list[str]:
    """Codes of what is wrong; empty if nothing."""
    found = []
    if not (rule.liked or rule.playlists or rule.track_ids):
        found.append("NO_SOURCE_SELECTED")
    found += [f"UNKNOWN_FILTER:{f.feature}" for f in rule.filters if f.feature not in known]
    found += [f"INVALID_RANGE:{f.feature}" for f in rule.filters if f.low is not None and f.high is not None and f.low > f.high]
    if sum(rule.weights.values()) <= 0:
        found.append("NO_SCORING_COMPONENTS")
    found += [f"UNKNOWN_FILTER:{name}" for name in rule.weights if name not in (*known, *DERIVED, *DERIVED_BY)]
    if rule.ordering in FUTURE_ORDERINGS:
        found.append("ORDERING_MODE_NOT_AVAILABLE_YET")
    if rule.sync_mode not in SYNC_MODES:
        found.append("UNKNOWN_SYNC_MODE")
    if not 1 <= rule.target_size <= MOST_TRACKS:
        found.append("TARGET_SIZE_INVALID")
    return found


def notices(rule: Rule, future: Sequence[str] = ()) -> list[str]:
    """Codes of what a rule asks for that has no effect yet, each once. future: features that are known but not computed."""
    found = ["CLUSTER_SOURCE_NOT_AVAILABLE_YET"] if rule.clusters or rule.cluster_diversity else []
    found += ["SEED_TRACKS_NOT_AVAILABLE_IN_PHASE_5"] if rule.seed_tracks else []
    named = [*(f.feature for f in rule.filters), *rule.weights, *(["vocal_balance"] if rule.vocal_balance else [])]
    return found + [f"FEATURE_NOT_AVAILABLE_YET:{n}" for n in dict.fromkeys(named) if n in (*future, "vocal_balance")]


def candidates(rule: Rule, liked: DataFrame, playlist_tracks: DataFrame) -> DataFrame:
    """Distinct ids of current likes, current items of the playlists and the ids named, less what is excluded."""
    spark = liked.sparkSession
    named = spark.createDataFrame([(i,) for i in rule.track_ids], "track_id long")
    found = named.unionByName(liked.where("is_current").select("track_id")) if rule.liked else named
    current = playlist_tracks.where("is_current")
    if rule.playlists:
        found = found.unionByName(current.where(F.col("playlist_id").isin(*rule.playlists)).select("track_id"))
    out = found.distinct()
    if rule.exclude_playlists:
        out = out.join(current.where(F.col("playlist_id").isin(*rule.exclude_playlists)).select("track_id"), "track_id", "left_anti")
    return out.where(~F.col("track_id").isin(*rule.exclude_track_ids)) if rule.exclude_track_ids else out


def _judged(rule: Rule, future: Sequence[str]) -> list[tuple[Column, str, Column, Any]]:
    """Per condition of a rule: a reason's code or null, the field, the row's value there and what is expected."""
    none = F.lit(None).cast("string")
    found: list[tuple[Column, str, Column, Any]] = []
    for f in rule.filters:
        if f.feature in future:
            continue
        value, status = F.col(f.feature), F.col(f"{f.feature}_status")
        absent = status.isNull() | status.isin("missing", "source_failed", "not_available_yet")
        code = F.when(status.isNull(), "FEATURE_MISSING").otherwise("FEATURE_NOT_AVAILABLE_YET") if f.required else none
        outside = none
        if f.high is not None:
            outside = F.when(value > f.high, RANGE_REASONS.get(f.feature, OTHER_RANGE))
        if f.low is not None:
            outside = F.when(value < f.low, RANGE_REASONS.get(f.feature, OTHER_RANGE)).otherwise(outside)
        unsure = F.when(status == "low_confidence", "FEATURE_LOW_CONFIDENCE").when(value.isNull(), "FEATURE_MISSING") if f.required else none
        found.append((F.when(absent, code).otherwise(F.coalesce(unsure, outside)), f.feature, F.when(~absent, value), {"min": f.low, "max": f.high}))
    for names, column, code in ((rule.availability, "availability", "TRACK_UNAVAILABLE"), (rule.market, "market_status", "MARKET_UNAVAILABLE")):
        if names:
            found.append((F.when(~F.coalesce(F.col(column).isin(*names), F.lit(False)), code), column, F.col(column), {"include": list(names)}))
    found += [(F.when(F.array_contains("artist_ids", a), "ARTIST_EXCLUDED"), "artist_id", F.lit(a), None) for a in rule.exclude_artists]
    found += [(F.when(F.col("album_id") == a, "ALBUM_EXCLUDED"), "album_id", F.lit(a), None) for a in rule.exclude_albums]
    return found


def reasons(rule: Rule, future: Sequence[str] = ()) -> Column:
    """Array of the reasons that exclude a row of the wide view; empty: it passes.

    A missing feature excludes only where required, one of low confidence too; otherwise its range still holds. Filters on
    features that are not computed yet have no effect, and need no column.
    """
    parts = [code for code, *_ in _judged(rule, future)]
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def details(rule: Rule, future: Sequence[str] = ()) -> Column:
    """reasons() with what they are about: an array of code, field, value (as text) and expected (as JSON text)."""
    kind = "array<struct<code:string,field:string,value:string,expected:string>>"
    parts = [
        F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(name).alias("field"), value.cast("string").alias("value"), F.lit(json.dumps(expected) if expected else None).cast("string").alias("expected")))
        for code, name, value, expected in _judged(rule, future)
    ]
    return F.array_compact(F.array(*parts)).cast(kind) if parts else F.array().cast(kind)


def score(rule: Rule, future: Sequence[str] = ()) -> Column:
    """Weighted mean of the usable components, their weights renormalised; null if none is usable. Those to come are passed over."""
    total, weights, usable = F.lit(0.0), F.lit(0.0), F.lit(0)
    for name, weight in rule.weights.items():
        if name in future:
            continue
        if name in DERIVED or name in DERIVED_BY:
            flag, yes, no = DERIVED_BY.get(name, (None, 0.0, DERIVED.get(name, 0.0)))
            value = F.lit(no) if flag is None else F.when(F.coalesce(F.col(flag), F.lit(False)), yes).otherwise(no)
            total, weights, usable = total + value * weight, weights + F.lit(float(weight)), usable + F.lit(1)
            continue
        low, high = rule.ranges.get(name, (None, None))
        fine = F.col(name).isNotNull() & ~F.coalesce(F.col(f"{name}_status").isin("missing", "low_confidence", "source_failed", "not_available_yet"), F.lit(True))
        value = min_max(F.col(name).cast("double"), F.lit(low).cast("double"), F.lit(high).cast("double"))
        total = total + F.when(fine, value * weight).otherwise(0.0)
        weights = weights + F.when(fine, float(weight)).otherwise(0.0)
        usable = usable + fine.cast("int")
    return F.when(usable > 0, clamp01(F.when(weights > 0, total / weights).otherwise(0.0)))


def one_cap(scored: DataFrame, by: str, most: int, size: int) -> DataFrame:
    """The best `size` rows with at most `most` of each value of `by`, exactly, without a fold. Nulls of `by` have no cap.

    One window: a row without a value is alone in its partition.
    """
    alone = F.when(F.col(by).isNull(), F.col("track_id"))
    rank = F.row_number().over(Window.partitionBy(by, alone).orderBy(F.desc("score"), "track_id"))
    return scored.withColumn("n", rank).where(F.col("n") <= most).drop("n").orderBy(F.desc("score"), "track_id").limit(size)


def _caps(rule: Rule) -> dict[str, int]:
    return {c: cap for c, cap in (("artist_id", rule.max_per_artist), ("album_id", rule.max_per_album)) if cap is not None}


def _competitive(scored: DataFrame, rule: Rule) -> DataFrame:
    """Rows that the caps can still choose, far fewer than all: an artist's rows that an album cap may skip stay.

    Per artist and album only the first max_per_artist, max_per_album rows (the smaller) can be taken, as further ones
    meet the same full quota. A null artist or album has no cap, so only the other's and target_size hold there.
    """
    most = F.least(F.lit(rule.target_size), *[F.when(F.col(c).isNotNull(), cap) for c, cap in _caps(rule).items()], F.lit(None))
    rank = F.row_number().over(Window.partitionBy("artist_id", "album_id").orderBy(F.desc("score"), "track_id"))
    return scored.withColumn("n", rank).where(F.col("n") <= rule.target_size).where(F.col("n") <= most).drop("n")


def _behind(score: Column, track_id: Column) -> Column:
    """Whether a row comes after the one of this score and id."""
    return (F.col("score") < score) | ((F.col("score") == score) & (F.col("track_id") > track_id))


def diversify(scored: DataFrame, rule: Rule) -> DataFrame:
    """track_id, score, artist_id, album_id of what a greedy scan in score order takes under both caps, target_size rows at most.

    Rounds, no scan. A row is taken if its place among the undecided rows of its artist, and of its album, is within what
    each has free: earlier rows cannot use that up. No undecided row comes before a row by which its artist or album
    became full, so the rows of full ones go. Once target_size rows are taken, those behind the last of them go too, and rows
    taken behind it are forgotten, as nothing before it depends on them. The first undecided row is taken in every
    round, so there are target_size rounds at most and one that takes nothing. What is taken is a written table of
    MOST_TRACKS rows at most, from which the undecided rows follow, so plans stay as they are; these are written anew when
    target_size is first reached, as few are left then. A window keeps max_per_artist or max_per_album rows of a key, so
    an artist with a third of all rows costs no more than another.
    """
    columns = ["track_id", "score", "artist_id", "album_id"]
    caps, size = _caps(rule), min(rule.target_size, MOST_TRACKS)
    order = [F.desc("score"), F.col("track_id")]
    base = written(_competitive(scored, rule).select(*columns))
    for c, cap in caps.items():
        base = base if cap > 0 else base.where(F.col(c).isNull())
    taken, held, known, cut = base.limit(0), base, None, False
    while True:
        sure = held
        for c, cap in caps.items():
            used = F.broadcast(taken.groupBy(c).agg(F.count("*").alias("used")))
            rank = F.row_number().over(Window.partitionBy(c).orderBy(*order))
            first = held.where(F.col(c).isNotNull()).withColumn("n", rank).where(F.col("n") <= cap)
            free = first.join(used, c, "left").where(F.col("n") <= cap - F.coalesce("used", F.lit(0)))
            able = free.select("track_id").unionByName(held.where(F.col(c).isNull()).select("track_id"))
            sure = sure.join(able, "track_id", "left_semi")
        taken = written(taken.unionByName(sure).orderBy(*order).limit(size))
        last = taken.agg(F.count("*"), F.max(F.struct(-F.col("score"), "track_id")), F.sum(F.xxhash64("track_id").cast("decimal(38,0)"))).first()
        if last == known:
            return taken
        known, held = last, base.join(F.broadcast(taken.select("track_id")), "track_id", "left_anti")
        for c, cap in caps.items():
            full = taken.groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") >= cap).select(c)
            held = held.join(F.broadcast(full), c, "left_anti")
        if last[0] == size:
            held = held.where(~_behind(F.lit(-last[1][0]), F.lit(last[1][1])))
            if not cut:
                base, cut = written(held.select(*columns)), True
                held = base


def capped(scored: DataFrame, rule: Rule, chosen: DataFrame) -> DataFrame:
    """(track_id, reason) of the rows that the caps passed over: the artist's cap, else the album's.

    A row is over a cap if it comes after the chosen row that filled it. Rows after the last one that target_size let in
    were not looked at and have no reason. chosen: as from diversify(), MOST_TRACKS rows at most, which is what is sent.
    """
    left = scored.select("track_id", "score", "artist_id", "album_id").join(F.broadcast(chosen.select("track_id")), "track_id", "left_anti")
    last = chosen.agg(F.count("*"), F.max(F.struct(-F.col("score"), "track_id"))).first()
    if last[0] >= rule.target_size:
        left = left.where(~_behind(F.lit(-last[1][0]), F.lit(last[1][1])))
    over = {}
    for c in ("artist_id", "album_id"):
        cap = _caps(rule).get(c)
        over[c] = F.lit(False)
        if cap == 0:
            over[c] = F.col(c).isNotNull()
        elif cap:
            rank = F.row_number().over(Window.partitionBy(c).orderBy(F.desc("score"), "track_id"))
            full = chosen.where(F.col(c).isNotNull()).withColumn("n", rank).where(F.col("n") == cap).select(c, F.col("track_id").alias(f"t_{c}"), F.col("score").alias(f"s_{c}"))
            left = left.join(F.broadcast(full), c, "left")
            over[c] = F.coalesce(_behind(F.col(f"s_{c}"), F.col(f"t_{c}")), F.lit(False))
    reason = F.when(over["artist_id"], "MAX_TRACKS_PER_ARTIST").when(over["album_id"], "MAX_TRACKS_PER_ALBUM")
    return left.select("track_id", reason.alias("reason")).where("reason is not null")


def spread(rows: list[tuple]) -> list[tuple]:
    """Greedy: the next row of another artist than the last placed one, else the next row. MOST_TRACKS rows at most.

    Rows are (track_id, score, artist, ...); a row without an artist is no one's neighbour.
    """
    left, out = list(rows), []
    while left:
        at = next((k for k, r in enumerate(left) if not out or r[2] is None or r[2] != out[-1][2]), 0)
        out.append(left.pop(at))
    return out


def ordered(chosen: list[tuple[int, float]], ordering: str, seed: int = 42, artists: Mapping[int, str] | None = None) -> list[tuple[int, float]]:
    """The selection's final order; orders of adding fall through to the score, and a seed of 0 or none counts 42.

    artists: the name of a track's first artist, for `artist_grouped`; tracks without one come first.
    """
    if ordering == "artist_grouped":
        return sorted(chosen, key=lambda r: ((artists or {}).get(r[0]) or "", -r[1], r[0]))
    if ordering == "artist_spread":
        return chosen
    if ordering == "random_seeded":
        out = list(chosen)
        random.Random(seed or 42).shuffle(out)
        return out
    return sorted(chosen, key=lambda r: (r[1], r[0])) if ordering == "score_asc" else sorted(chosen, key=lambda r: (-r[1], r[0]))


def arranged(chosen: DataFrame, rule: Rule) -> DataFrame:
    """position, track_id, score: what diversify() took in the rule's final order. Adds artist_name where `artist_grouped` has it.

    One task sees MOST_TRACKS rows at most; spreading and shuffling are one row after another by what they mean.
    """
    named = "artist_name" in chosen.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.itertuples(index=False)]
        rows = sorted(((r.track_id, r.score, None if pd.isna(r.artist) else r.artist, r.name) for r in rows), key=lambda r: (-r[1], r[0]))
        names = {r[0]: r[3] for r in rows}
        final = ordered([r[:2] for r in (spread(rows) if rule.spread_artists else rows)], rule.ordering, rule.seed, names)
        yield pd.DataFrame([(k, t, s) for k, (t, s) in enumerate(final)], columns=["position", "track_id", "score"])

    name = F.col("artist_name") if named else F.lit(None).cast("string")
    rows = chosen.select("track_id", F.col("score").cast("double").alias("score"), F.col("artist_id").cast("string").alias("artist"), name.alias("name"))
    return rows.coalesce(1).mapInPandas(place, "position int, track_id long, score double")


def preview(rule: Rule, view: DataFrame, liked: DataFrame, playlist_tracks: DataFrame, future: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(items, exclusions: track_id, reason, and of filters field, value and expected). view: the wide view with track_id, isrc, artist_id, album_id, artist_ids, availability.

    `artist_grouped` needs artist_names (in order) too. ISRC duplicates go before the filters, so a track that a filter
    drops still hides its duplicates. Rows that a cap passed over tell which; rows after the target size is reached
    have no exclusion. The judged rows are written once, and all that follows reads them. future: features that are not computed yet.
    """
    from crateflow.operators.duplicates import first_per_isrc

    pool = view.join(candidates(rule, liked, playlist_tracks), "track_id", "left_semi")
    names = F.get("artist_names", F.lit(0)) if "artist_names" in view.columns else F.lit(None).cast("string")
    columns = ["track_id", "isrc", "artist_id", "album_id"]
    judged = written(pool.select(*columns, names.alias("artist_name"), details(rule, future).alias("reasons"), score(rule, future).alias("score")))
    unique = first_per_isrc(judged)
    doubles = judged.select("track_id").join(unique.select("track_id"), "track_id", "left_anti").select("track_id", F.lit("DUPLICATE_ISRC_EXCLUDED").alias("reason"))
    dropped_ = unique.select("track_id", F.explode("reasons").alias("r")).select("track_id", F.col("r.code").alias("reason"), "r.field", "r.value", "r.expected")
    passed = unique.where(F.size("reasons") == 0)
    scored = passed.where(F.col("score").isNotNull())
    blank = passed.where(F.col("score").isNull()).select("track_id", F.lit("SCORE_NOT_COMPUTABLE").alias("reason"))
    chosen = diversify(scored, rule)
    over = capped(scored, rule, chosen)
    if rule.ordering == "artist_grouped":
        chosen = scored.select("track_id", "artist_name").join(F.broadcast(chosen), "track_id")
    others = doubles.unionByName(over).unionByName(blank)
    return arranged(chosen, rule), dropped_.unionByName(others, allowMissingColumns=True)
