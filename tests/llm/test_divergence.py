import re
from collections import Counter

from crateflow.llm import divergence, queries
from tests.llm.oracle import same

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, value string"


def terms_of(text):
    return TERM.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, k, least=3):
    docs = [(t or "", a or "", s or "") for t, a, s in docs]
    out = []
    for lang in {a for _, a, _ in docs}:
        mine = [(Counter(terms_of(t)), s) for t, a, s in docs if a == lang]
        kept = {w for w, n in Counter(w for c, _ in mine for w in c).items() if n >= least}
        groups = {s: Counter() for _, s in mine}
        for c, s in mine:
            groups[s].update({w: n for w, n in c.items() if w in kept})
        total = sum(groups.values(), Counter())
        prob = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: prob(c) for s, c in groups.items()}, prob(total)
        f = lambda x, y: (x - y) ** 2 // y
        for s in groups:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in groups if o != s)
            top = sorted((-f(p[s][w], q[w]), w) for w in kept if groups[s][w] and p[s][w] > q[w])[:k]
            for part, rows in (("pair", pairs), ("term", top)):
                out += [(lang, s, part, w.decode(), -v, n + 1) for n, (v, w) in enumerate(rows)]
    return sorted(out)


def check(spark, docs, k=200, least=3):
    frame = spark.createDataFrame([(n, t, a, s, "mine", "own") for n, (t, a, s) in enumerate(docs)], SCHEMA).repartition(3)
    assert sorted(map(tuple, divergence.audit(frame, k, least).collect())) == brute(docs, k, least)


def test_sql(spark):
    assert same(spark, "op11_source_divergence", queries.QUERIES, queries.ORACLES) > 10_000


def test_edges(spark):
    """Nulls, empty texts, groups and languages without terms, ties, repeated rows, bytes beyond ASCII, clashing names, a long text."""
    docs = [(f"Alpha beta{'x' * (k % 3)} ÉÉ é {'Zz ' * (k % 7)} {chr(97 + k % 11) * 3}", "en", f"s{k % 4}") for k in range(60)]
    docs += [(None, "en", "s9"), ("", "en", None), ("only once", "fr", "s1"), ("12 34 ++", "fr", "s2"), (None, None, None), ("word " * 300_000, "en", "s1")]
    docs += [("tie1 tiea tieb", "de", f"s{k % 2}") for k in range(6)] + [("日本 日本 ñ", "de", "é"), ("日本 ñ", "de", "z"), ("日本", "de", "z")]
    for k in (1, 2, 200):
        check(spark, docs, k)


def test_many_counts_and_groups(spark):
    """Zipf-like counts, so that buckets hold several counts and bounds cut; pairs in small pieces."""
    docs = [(" ".join(f"w{chr(97 + a)}{chr(97 + b)} " * (1 + (2000 * (1 + g % 3)) // (1 + 9 * a + b)) for a in range(9) for b in range(9 + g)), "en", f"s{g}") for g in range(7)]
    docs += [(f"w{chr(97 + k % 9)}{chr(97 + k % 15)} rare{chr(97 + k % 20)}", "en", f"s{k % 7}") for k in range(200)]
    before, divergence.PAIRS = divergence.PAIRS, 5
    try:
        for k in (3, 10):
            check(spark, docs, k, 1)
    finally:
        divergence.PAIRS = before


def test_few_held_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 4)
    check(spark, [(f"a b c d{'e' * (k % 5)}", "en", f"s{k % 3}") for k in range(30)])


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_counts_are_exact(spark):
    row = spark.sql("select 9000000000000 as n, 30000000000007 as t, 12345 as v")
    from pyspark.sql import functions as F

    got = row.select(divergence.probability(F.col("n"), F.col("t"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * 9000000000001 // (30000000000007 + 12345)
