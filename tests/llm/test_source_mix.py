import random
from fractions import Fraction

from pyspark.sql import functions as F

from crateflow.llm import queries
from crateflow.llm import source_mix as M

from .oracle import same


def test_against_sql(spark):
    assert same(spark, "op10_source_mix", queries.QUERIES, queries.ORACLES) == 1000


def fill(total, children):
    """Water-filling by repeated dealing; children: {name: (weight, capacity)}."""
    given, left, open_ = dict.fromkeys(children, Fraction(0)), Fraction(total), {k for k, (w, c) in children.items() if w and c}
    while open_ and left > 0:
        level = left / sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] - given[k] <= level * children[k][0]}
        if not full:
            for k in open_:
                given[k] += level * children[k][0]
            break
        for k in full:
            left -= children[k][1] - given[k]
            given[k] = Fraction(children[k][1])
        open_ -= full
    return given


def test_budgets_against_repeated_dealing(spark):
    rnd = random.Random(3)
    rows = [(f"d{rnd.randint(0, 2)}", f"s{rnd.randint(0, 5)}", "w " * rnd.choice([0, 1, 5, 40, 400])) for _ in range(80)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, domain string, source string, text string")
    levels = [M.Level("domain", {"d0": 7, "d1": 2}, 1), M.Level("source", {"s0": 5, "s1": 0}, 2)]
    for total in (0, 100, 3000, 10**9):
        got = {(r.domain, r.source): r.leaf_budget for r in M.mix(df, levels, total, max_epochs=2).collect()}
        tokens = {}
        for d, s, t in rows:
            tokens.setdefault(d, {}).setdefault(s, 0)
            tokens[d][s] += len(t.split())
        top = fill(total, {d: (dict(d0=7, d1=2).get(d, 1), 2 * sum(n for n in v.values())) for d, v in tokens.items()})
        for d, v in tokens.items():
            low = fill(top[d], {s: (dict(s0=5, s1=0).get(s, 2), 2 * n) for s, n in v.items()})
            for s in v:
                assert abs(got[(d, s)] - low[s]) <= len(v) + 4


def test_draws_a_prefix_of_the_seeded_order(spark):
    df = spark.range(500).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 9 as int)) as text", "'x' as source", "'clash' as rest")
    got = M.mix(df, [M.Level("source")], 3000, max_epochs=2, seed=5)
    rows = got.withColumn("key", M.order_key(5, F.lit(2), F.col("doc_id"), F.substring(F.md5(F.col("text").cast("binary")), 1, 8))).orderBy("key").collect()
    total = sum(r.n_tokens for r in rows)
    assert rows[0].rest == "clash" and total < 3000
    used = 0
    for r in rows:
        used += r.n_tokens
        assert r.n_copies == 1 + (used <= 3000 - total)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (4, "x", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.n_tokens, r.n_copies) for r in M.mix(df, [M.Level("source")], 1.0).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 2, 1), (4, 1, 1)}
    assert M.mix(df.limit(0), [M.Level("source")], 10).count() == 0
