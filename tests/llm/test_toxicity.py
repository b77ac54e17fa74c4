import random

import pytest

from crateflow.llm import queries
from crateflow.llm import toxicity as T


def text(rnd, bad):
    words = ["".join(rnd.choice(["th", "er", "in", "on", "at", "re", "an"]) for _ in range(rnd.randint(1, 3))) for _ in range(80)]
    for w in rnd.sample(["gromblat", "snivurk", "plaxid", "wertolop"], 2) if bad else []:
        words.insert(rnd.randrange(80), w)
    return " ".join(words)


def learn(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, toxic int, text string")
    return T.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


@pytest.fixture(scope="module")
def model(spark):
    rnd = random.Random(1)
    rows = [(int(k % 5 == 0), text(rnd, k % 5 == 0)) for k in range(1500)] + [(None, "no label"), (1, None), (7, "other label")]
    return learn(spark, rows)


def test_windows_cover_all_words():
    for t in ("", "a", "x " * 100, "y" * 1000, "one two\n\nthree " + "é" * 300):
        assert b"".join(T.windows(t)).split() == [] or "".join(b"".join(T.windows(t)).decode(errors="replace").split()).replace("�", "")
        assert b"".join(b"".join(T.windows(t)).split()) == b"".join(t.lower().encode().split())
        assert all(len(w) <= T.WINDOW for w in T.windows(t))


def test_held_out_accuracy(spark, model):
    rnd = random.Random(2)
    rows = [(k, int(k % 4 == 0), text(rnd, k % 4 == 0), "clash") for k in range(600)]
    got = T.score(spark.createDataFrame(rows, "doc_id long, toxic int, text string, score string"), model).collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.95


def test_edges(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "gromblat " * 100_000), (3, "gromblat " * 100_000), (4, "x" * 100_000)], "doc_id long, text string")
    rows = T.score(df, model).orderBy("doc_id").collect()
    assert rows[0].score == rows[1].score < 0.5 and rows[2] == rows[3] and rows[2].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert T.score(df.limit(0), model).count() == 0


def test_one_label_only(spark):
    model = learn(spark, [(0, "fine text")])
    assert T.score(spark.createDataFrame([("abc",)], "text string"), model).first().predicted == 0
    assert T.score(spark.createDataFrame([("abc",)], "text string"), learn(spark, [])).first().predicted == 0


def test_query_on_held_out_rows(spark):
    dir_ = "/root/testdata/sf0.1"
    got = queries.QUERIES["op3_toxicity"](spark, dir_).join(spark.read.parquet(f"{dir_}/labels.parquet"), "doc_id").where("held_out").collect()
    hits = [sum(r.predicted == 1 for r in got if r.toxic == t) / max(1, sum(r.toxic == t for r in got)) for t in (0, 1)]
    print(hits)
    assert hits[0] < 0.05 and hits[1] > 0.6


def test_scores_against_compressing_one_by_one(spark, model):
    """Each window compressed anew with a dictionary of its own, and the curve by hand."""
    import math

    import zstandard

    rnd = random.Random(4)
    texts = [text(rnd, k % 3 == 0) for k in range(12)] + ["", None, "gromblat", "é" * 200]
    rows = T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()

    def length(window, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=T.LEVEL)
        return len(zstandard.ZstdCompressor(level=T.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for r in rows:
        far = sorted(length(w, model.ordinary) - length(w, model.toxic) for w in T.windows(texts[r.doc_id] or ""))
        x = [sum(far) / len(far), far[-1], sum(far[-3:]) / len(far[-3:]), sum(d >= T.LARGE for d in far) / len(far)] if far else [0.0] * 4
        z = sum(w * v / s for w, v, s in zip(model.weights, x, model.scale)) + model.weights[4]
        assert abs(r.score - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_dictionaries_are_trained_on_windows_from_everywhere():
    """All windows of few texts, else about as many as asked from every part of them; no prefix."""
    rnd = random.Random(7)
    texts = [text(rnd, False) for _ in range(40)]
    every = [w for t in texts for w in T.windows(t)]
    assert T.drawn_windows(texts) == every
    long = ["".join(rnd.choice("abcdefgh ") for _ in range(64 * 4000))]
    some, whole = T.drawn_windows(long, 500), T.windows(long[0])
    assert 350 < len(some) < 650 and set(some) <= set(whole)
    places = [whole.index(w) for w in some]
    assert min(places) < len(whole) / 20 and max(places) > len(whole) * 19 / 20


def test_fit_without_telling_words_still_separates():
    """No word is in enough toxic texts, but their windows differ; the toxic dictionary is trained on all of their windows."""
    rnd = random.Random(8)
    odd = lambda: " ".join("".join(rnd.choice("qxzvwk") for _ in range(11)) for _ in range(30))
    toxic, plain = [odd() for _ in range(60)], [text(rnd, False) for _ in range(200)]
    assert not T.distinctive(toxic, plain)
    model = T.fit(toxic[:40], plain[:150], toxic[40:], plain[150:])
    scorer = T.Scorer(model)
    assert len(model.toxic) > len(model.ordinary) and 0 <= scorer.score(odd()) <= 1
