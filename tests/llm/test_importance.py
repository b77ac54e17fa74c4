import hashlib
import math
import re
import zlib
from collections import Counter

from crateflow.llm import importance, queries
from tests.llm.oracle import same

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, place int, rank string"


def words_of(text):
    folded = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return WORD.findall(folded)


def grams(words, longest):
    return [b" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(docs, target, s):
    feats = [grams(words_of(t), s.longest) for _, t in docs]

    def count(lists):
        found = Counter(zlib.crc32(f) % s.buckets for x in lists for f in x)
        return [found[b] for b in range(s.buckets)]

    a, b = count(feats), count([grams(words_of(t), s.longest) for t in target])
    gain = [math.floor(1000 * math.log((y + 1) * (sum(a) + s.buckets) / ((x + 1) * (sum(b) + s.buckets)))) for x, y in zip(a, b, strict=True)]
    rows = []
    for (i, t), f in zip(docs, feats, strict=True):
        weight = sum(gain[zlib.crc32(x) % s.buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(t))))
    able = sorted((r for r in rows if r[4] >= s.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(r[:4], k + 1) for k, r in enumerate(able[: s.percent * len(able) // 100])]
    return rows, ranks  # in order of rank


def check(spark, docs, target, s):
    frame = spark.createDataFrame([(i, t, "mine", 7, "r") for i, t in docs], SCHEMA).repartition(3)
    got = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), s, carry=["place", "rank"]).collect()
    rows, ranks = brute(docs, target, s)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((r[:4] for r in rows), key=key)
    assert sorted(((tuple(r)[:4], r["rank"]) for r in got if r["rank"]), key=lambda x: x[1]) == ranks
    assert all(r["carried"]["place"] == 7 and r["carried"]["rank"] == "r" for r in got)


def test_sql(spark):
    assert same(spark, "op13_importance_resampling", queries.QUERIES, queries.ORACLES) == 1000


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows and ids, names that clash; single words and runs of two and three."""
    docs = [(k, f"Alpha beta{k % 5} ÄÖ{k % 3} g7 " * (k % 9)) for k in range(60)]
    docs += [(1, None), (2, ""), (3, "... !!"), (4, "same words here " * 9), (4, "same words here " * 9), (None, "no id at all " * 8), (99, "word " * 20_000)]
    for longest in (1, 3):
        check(spark, docs, ["alpha gamma g7", None, "beta1 beta1"], importance.Settings(buckets=97, longest=longest, percent=30))


def test_runs_cross_the_parts_of_a_long_text(monkeypatch):
    from crateflow.llm import words

    monkeypatch.setattr(words, "PART_BYTES", 7)
    text = b"One two, three four five-six seven eight nine" * 3
    for longest in (1, 2, 4):
        found, n = importance.features(text, longest, importance._Buckets(1000))
        want = grams(words_of(text.decode()), longest)
        assert sorted(x for f in found for x in f.tolist()) == sorted(zlib.crc32(g) % 1000 for g in want) and n == len(words_of(text.decode()))


def test_equal_scores_go_to_the_smaller_id(spark):
    counts = [(5, 2), (9, 1), (3, 4)]
    assert [importance._threshold(counts, k) for k in (1, 2, 3, 4, 7, 8)] == [9, 5, 5, 3, 3, None]
    docs = [(7, "w " * 20)] * 5 + [(6, "w " * 20)] * 5
    check(spark, docs, [], importance.Settings(percent=40))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, none).count() == 0
    none.write.parquet(f"{tmp_path}/none")
    assert importance.resample(spark.read.parquet(f"{tmp_path}/none"), none).columns == ["doc_id", "n_features", "weight", "score", "rank"]
