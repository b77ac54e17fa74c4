import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from crateflow.llm import lm_scoring as L
from crateflow.llm import queries

TEXTS = ["The cat sat on the mat.", "the dog SAT on the log", "", None, "a cat, a dog; é ñandú", "the the the the", "zzz\x0bqqq\x1cx", "the cat " * 300]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(train, texts, depth):
    """log10 probabilities, node by node."""
    counts = Counter()
    children = {}

    def steps(text):
        data = bytes([L.PAD]) * depth + lowered(text).encode() + bytes([L.END])
        for k in range(depth, len(data)):
            for j in range(8):
                yield data[k - depth : k], (1 << j) | data[k] >> 8 - j, data[k] >> 7 - j & 1

    for t in train:
        for ctx, before, bit in steps(t):
            for d in range(depth + 1):
                counts[ctx[depth - d :], before, bit] += 1
                if d:
                    children.setdefault((ctx[depth - d + 1 :], before), set()).add(ctx[depth - d :])

    def kt(ctx, before):
        a, b = counts[ctx, before, 0], counts[ctx, before, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1), (b + 0.5) / (a + b + 1)

    @lru_cache(None)
    def weighted(ctx, before):
        own = kt(ctx, before)[0]
        if len(ctx) == depth:
            return own
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(c, before) for c in children[ctx, before]))

    def p(ctx, before, bit):
        found = None
        for d in range(depth, -1, -1):
            c = ctx[depth - d :]
            if counts[c, before, 0] + counts[c, before, 1] == 0:
                continue
            own, one = kt(c, before)
            own_p = one if bit else 1 - one
            w = 1.0 if d == depth else math.exp(math.log(0.5) + own - weighted(c, before))
            found = own_p if found is None else w * own_p + (1 - w) * found
        return 0.5 if found is None else found

    return [sum(math.log10(p(*s)) for s in steps(t)) for t in texts]


def base(train, texts):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), None]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for t in texts], n


def check(spark, hot):
    rows = list(enumerate(TEXTS)) + [(1, TEXTS[1])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")
    got = sorted(L.score(df, F.col("doc_id") % 3 != 1, hot=hot).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    train = [t for i, t in rows if i % 3 != 1]
    rows.sort(key=lambda r: r[0])
    want, (words, n) = brute(train, [t for _, t in rows], L.DEPTH), base(train, [t for _, t in rows])
    assert len(got) == len(rows)
    for r, s, (tokens, known, b) in zip(got, want, words, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert abs(r.base_score - b) < 1e-8 and abs(r.score - s) < 1e-4 * max(1, -s)


def test_against_brute_force_with_all_keys_broadcast(spark):
    check(spark, 1 << 18)


def test_against_brute_force_with_all_keys_joined(spark):
    check(spark, 0)


def test_against_brute_force_with_some_of_each(spark):
    check(spark, 30)


def test_places():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 5000))
    places = L.Places(keys[::2])
    assert np.array_equal(places.find(keys), np.where(np.arange(len(keys)) % 2 == 0, np.arange(len(keys)) // 2, -1))
    assert L.Places(np.zeros(0, np.int64)).find(keys).max() == -1


def test_gamma():
    x = np.concatenate([np.linspace(0.5, 50, 500), np.geomspace(50, 1e12, 200)])
    assert np.allclose(L._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-9)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert L.score(df.limit(0), F.lit(True)).count() == 0
    r = L.score(df, F.lit(None).cast("boolean")).first()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, None) and abs(r.score - 3 * math.log10(1 / 256)) < 1e-6


def test_held_out_texts_beat_the_base(spark):
    got = queries.QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b
    ids = queries.QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in ids)
