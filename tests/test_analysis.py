import json
import random

import pytest
from pyspark.sql import functions as F

from crateflow.operators import work
from crateflow.sources import analysis


def plain(node):
    return float(node) if isinstance(node, (int, float)) and not isinstance(node, bool) else None


def mean_of(node):
    """A node's number, read by hand."""
    if plain(node) is not None:
        return plain(node)
    if isinstance(node, list):
        found = [plain(x) for x in node if plain(x) is not None]
        return sum(found) / len(found) if found else None
    if isinstance(node, dict):
        for name in ("mean", "value", "avg", "average"):
            got = mean_of(node.get(name)) if name == "mean" and isinstance(node.get(name), list) else plain(node.get(name))
            if got is not None:
                return got
    return None


def a_node(rnd, depth=0):
    kind = rnd.randint(0, 7)
    if kind < 2:
        return rnd.choice([0, 1, 2.5, -7, 1e3])
    if kind == 2:
        return rnd.choice([None, "", "x", "3", False])
    if kind == 3 or depth:
        return [rnd.choice([1, 2.5, "x", None, 9]) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(["mean", "value", "avg", "average", "median"]): a_node(rnd, 1) for _ in range(rnd.randint(0, 3))}


def test_every_shape_of_a_number(spark):
    rnd = random.Random(4)
    nodes = [a_node(rnd) for _ in range(300)]
    docs = spark.createDataFrame([(k, json.dumps({"rhythm": {"bpm": n}, "lowlevel": {"loudness": n, "average_loudness": 4, "spectral_centroid": n}})) for k, n in enumerate(nodes)], "id int, value string")
    for r in analysis.analysis_documents(docs).collect():
        n = nodes[r.id]
        assert (r.bpm, r.centroid) == (mean_of(n), mean_of(n)), n
        assert r.loudness == mean_of(n if n else 4), n
        assert r.bpm_confidence == (0.85 if r.bpm is not None else None)


def test_documents(spark):
    """Names that clash with columns, malformed texts, other roots, long numbers, keys and vectors in their places."""
    texts = [
        '{"tonal": {"key_edma": "no", "key_krumhansl": {"key": "Eb", "scale": "maj", "strength": 0.4}, "key_temperley": {"key": "A"}, "hpcp": {"mean": [1, 2]}}, "rhythm": {"beats_count": 7.9, "onset_rate": [1, 3]}, "lowlevel": {"onset_rate": 0, "mfcc": 5, "spectral_contrast": {"mean": 3}}}',
        '{"tonal": {"key": 4, "scale": 0, "key_strength": "x"}, "lowlevel": {"mfcc": {"mean": [1, null, 2]}, "hpcp": {}}, "metadata": {"audio_properties": {"length": 1.9999}}}',
        "{bad", "[1, 2]", "7", "", None, '{"rhythm": 3, "tonal": [], "lowlevel": null}',
    ]
    docs = spark.createDataFrame([(k, t, "mine", 1) for k, t in enumerate(texts)], "id int, value string, rhythm string, d int")
    rows = sorted(analysis.analysis_documents(docs).collect(), key=lambda r: r.id)
    a, b = rows[:2]
    assert (a.key, a.mode, a.key_confidence, a.hpcp, a.beats_count, a.onset_rate, a.mfcc, a.spectral_contrast) == (3, 1, 0.4, [1.0, 2.0], 7, 2.0, [5.0], [])
    assert (b.key, b.mode, b.key_confidence, b.mfcc, b.hpcp, b.duration_ms) == (4, 0, None, [1.0, 2.0], [], 1999)
    assert all(r.bpm is None and r.bpm_confidence is None and r.key is None for r in rows[2:])
    assert [r.mfcc for r in rows[2:]] == [None] * 5 + [[]] and all(r.rhythm == "mine" and r.d == 1 for r in rows)


def test_the_plan_stays_small(spark):
    """What is chosen once is a column, not an expression repeated at each use: the kind of a node is asked some hundred times, not thousands."""
    docs = spark.createDataFrame([(1, "{}")], "id int, value string")
    plan = analysis.analysis_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SchemaOfVariant") < 300


def test_kinds_that_look_alike(spark):
    """Members only of objects, elements only of lists, no numbers out of texts or truth values; keys out of blocks."""
    nodes = ['"[1, 2]"', '"3"', "true", "[true, 4]", '{"mean": "[5]", "value": 6}', '{"0": 1}', '[{"mean": 2}]', '{"mean": true, "avg": "7", "average": 8}']
    texts = [f'{{"rhythm": {{"bpm": {n}}}, "lowlevel": {{"loudness": {n}, "average_loudness": 9, "mfcc": {n}}}}}' for n in nodes]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    rows = sorted(analysis.analysis_documents(docs).collect(), key=lambda r: r.id)
    want = [None, None, None, 4.0, 6.0, None, None, 8.0]
    assert [r.bpm for r in rows] == want and [r.loudness for r in rows] == want
    assert [r.mfcc for r in rows] == [[], [], [], [4.0], [6.0], [], [], [8.0]]
    keys = ['"key_key": null, "key": null, "key_edma": {"key": "D", "scale": "min"}', '"key_key": "", "key": false, "scale": 0, "key_edma": {"scale": "maj"}', '"key_key": "x", "key_edma": {"key": "D"}', '"key": " C# ", "scale": "MAJOR"']
    docs = spark.createDataFrame([(k, f'{{"tonal": {{{t}}}}}') for k, t in enumerate(keys)], "id int, value string")
    rows = sorted(analysis.analysis_documents(docs).collect(), key=lambda r: r.id)
    assert [(r.key, r.mode) for r in rows] == [(2, 0), (None, 1), (None, None), (1, 1)]


def test_storage_round_trip(spark):
    docs = spark.createDataFrame([(1, '{"rhythm": {"bpm": 120.5, "perceptual_tempo": {"mean": 3}}, "lowlevel": {"mfcc": {"mean": [1, 2]}, "spectral_centroid": 7}, "tonal": {"key": "c"}}')], "id int, value string")
    measured = analysis.analysis_documents(docs)
    kept = measured.select(analysis.stored(measured).alias("s")).unionByName(spark.createDataFrame([('{"bpm": 99.0, "raw_summary": {"a": 1}}',), ("{bad",), ('{"match_confidence": 0, "source_quality_weight": 0.5}',)], "s string"))
    rows = [r.asDict() for r in analysis.restored(kept.coalesce(1), "s").drop("raw_summary").collect()]
    assert (rows[0]["bpm"], rows[0]["mfcc"], rows[0]["spectral_centroid"], rows[0]["key"], rows[0]["match_confidence"]) == (120.5, [1.0, 2.0], 7.0, 0, 1.0)
    assert (rows[1]["bpm"], rows[1]["hpcp"]) == (99.0, []) and rows[2]["hpcp"] is None and (rows[3]["match_confidence"], rows[3]["source_quality_weight"]) == (1.0, 0.5)


def resolved(profiles, models, start):
    """The walk by hand: parents first, dependencies before what needs them."""
    out = []

    def add(m):
        for d in models.get(m, []):
            add(d)
        if m not in out:
            out.append(m)

    chain = []
    while start in profiles and start not in chain:
        chain.append(start)
        start = profiles[start][0]
    for p in reversed(chain):
        for m in profiles[p][1]:
            add(m)
    return out


def test_profiles_in_order_of_dependencies(spark):
    rnd = random.Random(2)
    for n in range(3):
        models = {f"m{k}": [f"m{d}" for d in rnd.sample(range(k), min(k, rnd.randint(0, 2)))] for k in range(10)}
        profiles = {f"p{k}": (f"p{(k + 1) % 4}" if rnd.random() < 0.8 else None, [f"m{rnd.randint(0, 11)}" for _ in range(3)]) for k in range(4)}
        p = spark.createDataFrame([(k, e, ms) for k, (e, ms) in profiles.items()], "name string, extends string, models array<string>")
        m = spark.createDataFrame(list(models.items()), "model string, depends_on array<string>")
        got = [r.model for r in work.profile_models(p, m, "p0").orderBy("place").collect()]
        assert got == resolved(profiles, models, "p0"), n
    with pytest.raises(ValueError, match="PROFILE_NOT_FOUND"):
        work.profile_models(p, m, "none")
    assert work.profile_models(p.withColumn("models", F.lit(None).cast("array<string>")), m, "p0").count() == 0
