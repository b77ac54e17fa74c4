import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from crateflow.functions import text
from crateflow.operators import jobs, matching, rule_documents, rules

GOOD = {
    "name": "n", "source": {"liked_tracks": True, "playlists_include": [1]}, "filters": {"features": {"tempo": {"min": 70, "max": 150}, "later": {"required": True}}, "availability_status": {"include": ["available"], "exclude": ["x"]}},
    "weights": {"components": {"bpm": {"weight": 0.5}, "freshness_score": {"weight": 1}}}, "constraints": {"max_tracks_per_artist": 3}, "ordering": {}, "spotify": {},
}


def changed(path, value):
    doc = json.loads(json.dumps(GOOD))
    at = doc
    for k in path.split(".")[:-1]:
        at = at.setdefault(k, {})
    if value is KeyError:
        del at[path.split(".")[-1]]
    else:
        at[path.split(".")[-1]] = value
    return doc


def check(doc=None, **more):
    return rule_documents.check(doc, known=["bpm", "energy"], future=["later"], **more)


def test_a_good_document():
    found = check(GOOD)
    assert found.valid and [(w.code, w.path) for w in found.warnings] == [("FEATURE_NOT_AVAILABLE_YET", "filters.features.later")]
    assert found.normalised["target_size"] == 80 and found.normalised["constraints"]["vocal_balance"] == {"enabled": False} and found.normalised["filters"]["market_status"] is None
    rule = found.rule
    assert (rule.liked, list(rule.playlists), rule.max_per_artist, rule.target_size, rule.sync_mode) == (True, [1], 3, 80, "replace_after_dry_run")
    assert rule.filters[0] == rules.FeatureFilter("bpm", 70.0, 150.0) and rule.weights == {"bpm": 0.5, "freshness_score": 1.0} and list(rule.availability) == ["available"]
    assert check(found.normalised).normalised == found.normalised


@pytest.mark.parametrize("path, value, code", [
    ("target_size", 501, "TARGET_SIZE_INVALID"), ("target_size", 0, "TARGET_SIZE_INVALID"), ("target_size", "many", "RULE_INVALID_SCHEMA"), ("name", KeyError, "RULE_INVALID_SCHEMA"), ("source", [1], "RULE_INVALID_SCHEMA"),
    ("source.playlists_include", ["x"], "RULE_INVALID_SCHEMA"), ("source.liked_tracks", 3, "RULE_INVALID_SCHEMA"), ("filters.features", {"zzz": {}}, "UNKNOWN_FILTER"), ("filters.features", {"bpm": {"min": 2, "max": 1}}, "INVALID_RANGE"),
    ("weights.components", {}, "NO_SCORING_COMPONENTS"), ("weights.components", {"bpm": {"weight": 0}}, "NO_SCORING_COMPONENTS"), ("weights.components", {"zzz": {"weight": 1}}, "UNKNOWN_FILTER"), ("ordering.mode", "cluster_walk", "ORDERING_MODE_NOT_AVAILABLE_YET"),
    ("ordering.mode", "zzz", "RULE_INVALID_SCHEMA"), ("spotify.sync_mode", "zzz", "UNKNOWN_SYNC_MODE"), ("spotify.visibility", "zzz", "RULE_INVALID_SCHEMA"), ("source", {}, "NO_SOURCE_SELECTED"),
])
def test_wrong_documents(path, value, code):
    found = check(changed(path, value))
    where = {"RULE_INVALID_SCHEMA": path if path != "source.playlists_include" else f"{path}.0", "TARGET_SIZE_INVALID": path}.get(code)
    assert not found.valid and found.normalised is None and found.rule is None
    assert [e.code for e in found.errors] == [code] and (where is None or found.errors[0].path == where)


def test_other_roots_and_texts():
    assert [e.code for e in check().errors] == [e.code for e in check([1]).errors] == ["RULE_INVALID_SCHEMA"]
    pytest.importorskip("yaml")
    assert check(text=json.dumps(GOOD)).valid and [e.code for e in check(text="a: [").errors] == ["RULE_INVALID_YAML"]


def test_warnings():
    doc = changed("source.seed_tracks", ["t"])
    doc["source"]["clusters_exclude"], doc["constraints"]["cluster_diversity"], doc["constraints"]["vocal_balance"] = [1], {"enabled": True}, {"enabled": True}
    assert [w.path for w in check(doc).warnings] == ["source", "source.seed_tracks", "filters.features.later", "constraints.cluster_diversity", "constraints.vocal_balance"]


def test_filters_to_come_are_passed_over(spark):
    rule = check(GOOD).rule
    rows = spark.createDataFrame([(1, 60.0, "available", "available", True), (2, 100.0, "available", "restricted", False), (3, None, "missing", None, None)], "track_id long, bpm double, bpm_status string, availability string, liked boolean")
    got = {r.track_id: [tuple(x) for x in r.d] for r in rows.select("track_id", rules.details(rule, ["later"]).alias("d")).collect()}
    assert got == {1: [("BPM_OUT_OF_RANGE", "bpm", "60.0", '{"min": 70.0, "max": 150.0}')], 2: [("TRACK_UNAVAILABLE", "availability", "restricted", '{"include": ["available"]}')], 3: [("TRACK_UNAVAILABLE", "availability", None, '{"include": ["available"]}')]}
    assert [r.r for r in rows.select(rules.reasons(rule, ["later"]).alias("r")).collect()] == [[x[0] for x in got[k]] for k in (1, 2, 3)]
    assert [round(r.s, 6) for r in rows.orderBy("track_id").limit(1).select(rules.score(rule, ["later"]).alias("s")).collect()] == [round((1 * 0.5 + 0.5) / 1.5, 6)]


def test_bounds_hold_and_cut(spark):
    """The best of each track equals a comparison of all; few candidates are compared."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 12)))
    rows = []
    for t in range(30):
        mine, length = word(), rnd.randint(1, 60)
        for k in range(25):
            other = mine[:-1] + "z" if k == 7 else word()
            rows.append((t, k, mine, float(length), other.upper() if k % 2 else other, None if k == 9 else float(length + rnd.randint(-20, 20))))
    df = spark.createDataFrame(rows, "track_id long, ordinal int, text string, duration_s double, c_text string, c_duration_s double")
    clean = lambda x: " ".join(x.lower().split())
    want = {}
    for t, k, a, d, b, e in rows:
        if e is not None and abs(d - e) <= 15:
            s = 0.7 * SequenceMatcher(None, clean(a), clean(b)).ratio() + 0.3 * max(0.0, 1 - abs(d - e) / max(d, 1.0))
            if t not in want or s > want[t][1] + 1e-12:
                want[t] = (k, s)
    best, compared = matching.best_downloads(df)
    got = {r.track_id: (r.ordinal, r.score) for r in best.collect()}
    assert got.keys() == want.keys() and all(abs(got[t][1] - want[t][1]) < 1e-9 for t in want) and compared.count() < len(rows) / 3
    pairs = spark.createDataFrame([(a, b) for _, _, a, _, b, _ in rows] + [("", ""), (None, "x")], "a string, b string")
    assert pairs.where(text.ratio_bound(F.col("a"), F.col("b")) < text.sequence_ratio(F.col("a"), F.col("b")) - 1e-12).count() == 0


def test_results_of_ended_jobs(spark):
    kind = "job_id long, item_id long, track_id long, stage string, status string, result_json string, error_message string, finished_at timestamp_ntz"
    items = spark.createDataFrame([(1, 1, 1, "x", "success", '{"is_available": "yes"}', None, None), (1, 2, 2, "x", "success", "{bad", None, None), (2, 3, 1, "cleanup", "failed", None, "e" * 3000, None), (2, 4, 1, "download", "blocked", None, None, None), (3, 5, 1, "cleanup", "success", None, None, None)], kind)
    ended = spark.createDataFrame([(1, "preview_resolve", 9), (2, "audio_analysis_pipeline", 0), (3, "audio_analysis_pipeline", None)], "job_id long, job_type string, track_count long")
    got = {r.job_id: r for r in jobs.terminal_results(ended, items).collect()}
    assert set(got) == {1, 3} and (got[1].succeeded, got[1].not_found, got[1].track_count, got[1].status, got[1].stages) == (1, 1, 9, "succeeded", None)
    assert (got[3].tracks_completed, got[3].stages, got[3].track_count) == (1, {"cleanup:success": 1}, 1)
