import numpy as np
import pytest
from pyspark.sql import functions as F

from crateflow.llm import language_id as L

TRAIN = [("en", "the house and the garden of the king"), ("en", "there was nothing in the other room"), ("de", "das haus und der garten des königs"), ("de", "es gab nichts in dem anderen zimmer"), (None, "no language"), ("de", None)]


@pytest.fixture(scope="module")
def model(spark):
    return L.learn(spark.createDataFrame(TRAIN, "lang string, text string"))


def brute_grams(text):
    words = "".join(c if ord(c) >= 0x80 or c.isalpha() else " " for c in text.lower()).split()
    data = (" " + " ".join(words) + " ").encode()
    return [data[k : k + 4] for k in range(len(data) - 3)]


def test_grams_are_those_of_the_plain_definition():
    texts = ["The  HOUSE, und 12 ñandú!", "", "a", "x\n\n y"]
    grams, at = L._grams(texts)
    for k, t in enumerate(texts):
        assert [int(g).to_bytes(4, "little") for g in grams[at[k] : at[k + 1]]] == brute_grams(t)


def test_filters_hold_every_gram_of_their_language(model):
    for lang, text in TRAIN:
        if lang and text:
            grams, _ = L._grams([text])
            a, b, c = (model.table[s, 0] for s in L._slots(grams))
            assert np.all((a & b & c) >> model.languages.index(lang) & 1)


def test_false_positives_are_those_expected(model):
    grams = np.random.default_rng(5).integers(0, 1 << 32, 200_000, dtype=np.uint32)
    a, b, c = (model.table[s, 0] for s in L._slots(grams))
    for k in range(2):
        assert abs(np.mean((a & b & c) >> k & 1) - model.false_positive[k]) < 1e-3


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "the king"), (5, "der könig"), (5, "der könig"), (6, "q"), (7, "the garden " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit("zz"))
    found = [(r.doc_id, r.lang_pred) for r in L.predict(df, model).orderBy("doc_id").collect()]
    assert found == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de"), (6, "de"), (7, "en")]
    assert L.predict(df.limit(0), model).count() == 0


def test_nothing_learned(spark):
    model = L.learn(spark.createDataFrame([], "lang string, text string"))
    assert [r.lang_pred for r in L.predict(spark.createDataFrame([("abc",)], "text string"), model).collect()] == ["und"]


def test_held_out_accuracy(spark):
    from crateflow.llm import queries

    dir_ = "/root/testdata/sf0.01"
    got = queries.QUERIES["op2_language_id"](spark, dir_)
    truth = spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "lang")
    row = got.join(truth, "doc_id").where("held_out").agg(F.avg(F.expr("double(lang = lang_pred)")).alias("share"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row.share > 0.97 and row.low >= 0 and row.high <= 1


def test_scores_against_counting_one_by_one(spark):
    """Each n-gram of each text looked up bit by bit, the counts corrected, the best language's share of them."""
    texts = ["The house of the king", "das Haus des Königs ist groß", "la maison du roi", "", None, "12 34", "ééé", "the", "the house das haus " * 40]
    learned = spark.createDataFrame([("en", texts[0]), ("de", texts[1]), ("fr", texts[2])] * 3, "lang string, text string")
    model = L.learn(learned)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("result", F.lit("clash"))
    got = {r.doc_id: r for r in L.predict(rows, model).collect()}

    def grams(text):
        data = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in (text or "").lower().encode())
        data = b" " + b" ".join(data.split(b" ")) + b" "
        while b"  " in data:
            data = data.replace(b"  ", b" ")
        return [int.from_bytes(data[k : k + 4], "little") for k in range(len(data) - 3)]

    for k, text in enumerate(texts):
        counts = []
        for bit in range(len(model.languages)):
            has = sum(all(int(model.table[(g * m % 2**32) >> (32 - L.SLOT_BITS), 0]) >> bit & 1 for m in L.MULTIPLIERS) for g in grams(text))
            f = float(model.false_positive[bit])
            counts.append(max(0.0, (has - len(grams(text)) * f) / (1 - f)))
        if not text or not any(map(str.isalpha, text)):
            assert (got[k].lang_pred, got[k].score) == (L.UNKNOWN, 0.0)
        elif sum(counts) == 0:
            assert (got[k].lang_pred, got[k].score) == (model.fallback, 0.0)
        else:
            assert got[k].lang_pred == model.languages[counts.index(max(counts))] and abs(got[k].score - max(counts) / sum(counts)) < 1e-9


def test_filters_are_those_of_counted_grams(spark):
    """The table made anew: each language's n-grams counted by hand, those of the share kept, whatever others have, and their bits set."""
    texts = [("en", "the king of the house " * 30 + "zebra"), ("de", "das haus the " * 20), ("fr", "la maison"), ("fr", None), (None, "no")]
    share = 1 / 150
    model = L.learn(spark.createDataFrame(texts, "lang string, text string"), share=share)
    want = np.zeros((1 << L.SLOT_BITS, 1), np.uint8)
    shared = set()
    for lang in ("de", "en", "fr"):
        grams = [int.from_bytes(g, "little") for a, t in texts if a == lang and t for g in brute_grams(t)]
        kept = {g for g in set(grams) if grams.count(g) / len(grams) >= share}
        shared |= {(lang, g) for g in kept}
        assert lang != "en" or kept != set(grams)
        for g in kept:
            for m in L.MULTIPLIERS:
                want[(g * m % 2**32) >> (32 - L.SLOT_BITS), 0] |= 1 << model.languages.index(lang)
    assert model.languages == ["de", "en", "fr"] and np.array_equal(model.table, want)
    the = int.from_bytes(b"the ", "little")
    assert ("de", the) in shared and ("en", the) in shared
