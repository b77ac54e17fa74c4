import math
from collections import Counter

from crateflow.llm import queries
from crateflow.llm import url_filter as U

from .oracle import same

RULES = queries.URL_RULES


def brute_windows(url):
    s = U.START * U.ORDER + url + U.END
    return [s[k : k + U.ORDER + 1] for k in range(len(s) - U.ORDER)]


def probability(counts, gram):
    p = U.LEAST
    for k in range(1, U.ORDER + 2):
        g = gram[-k:]
        n, t = counts["n", g[:-1], k], counts["t", g[:-1], k]
        p = (counts["g", g] + t * p) / (n + t) if n else p
    return p


def learn(urls):
    counts = Counter()
    for u in urls:
        for w in brute_windows(u):
            for k in range(1, U.ORDER + 2):
                g = w[-k:]
                counts["g", g] += 1
                counts["n", g[:-1], k] += 1
    for kind, g, *_ in [k for k in counts if k[0] == "g"]:
        counts["t", g[:-1], len(g)] += 1
    return counts


def test_against_sql(spark):
    assert same(spark, "op5_url_filter", queries.QUERIES, queries.ORACLES) == 250


def test_values_against_brute_force(spark):
    urls = [f"http://{h}.{d}/{p}/{k}" for k, (h, d, p) in enumerate([(h, d, p) for h in ("www", "m", "é") for d in ("example.net", "example.com", "example.org") for p in ("en", "fr", "de")] * 2)]
    urls += urls[:5] + ["", "no scheme", "HTTP://WWW.Example.NET/en/?q=://x#y"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(99, None)], "page_id long, url string")
    rows = U.judge(df, RULES).collect()
    fold = {r.url: r.f for r in df.select("url", U.fold_of(df.url).alias("f")).collect()}
    known = {r.url: {x.name: x.verdict for x in RULES}.get(r.rule) for r in rows}
    models = {v: learn([u for u in urls if known[u] == v and fold[u] != 0]) for v in ("allow", "block")}
    for r in rows:
        grams = brute_windows(r.url or "")
        total = sum(round((math.log(probability(models["allow"], g)) - math.log(probability(models["block"], g))) * U.UNIT) for g in grams)
        assert abs(r.value - math.floor(total / len(grams))) <= 1
        assert r.verdict == (known[r.url] or ("allow" if r.value >= r.threshold else "block"))


def test_hosts_paths_and_rules(spark):
    cases = {
        "https://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/"), "http://example.net": ("example.net", "", None), "http://example.net/EN/": ("example.net", "/EN/", "net/"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/"), "x://y.org/fr/#z": ("y.org", "/fr/", "org/fr/"), "http://h.example.com/de/1": ("h.example.com", "/de/1", "example.com/de/"),
        "http://q?://z": ("q", "", None), "nothing": ("", "", None), None: ("", "", None),
    }
    df = spark.createDataFrame([(u, "clash") for u in cases], "url string, host string")
    for r in U.judge(df, RULES).collect():
        assert (r.host, r.path, r.rule) == cases[r.url]
    assert U.judge(df.limit(0), RULES).count() == 0


def test_thresholds():
    assert U.best_threshold([]) == 0 and U.best_threshold([(3, 5, 0)]) == 0
    assert U.best_threshold([(-2, 0, 9), (4, 9, 0)]) == 0
    assert U.best_threshold([(2, 0, 9), (4, 9, 0)]) == 3 * U.STEP


def test_of_two_equally_long_rules_the_first_counts(spark):
    first, second = U.UrlRule("a.net", "/", "block"), U.UrlRule("net", "/xy", "allow")
    df = spark.createDataFrame([("http://a.net/xyz",)], "url string")
    for rules in ((first, second), (second, first)):
        assert U.judge(df, rules).first().rule == rules[0].name


def test_windows_of_any_characters(spark):
    urls = ["", "a", "\U0001f600é\U0001f600", "x\ny" * 5]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in df.select("url", U._windows(df.url).alias("w")).collect():
        assert r.w == brute_windows(r.url)


def test_other_columns_stay_whatever_their_names(spark):
    rows = spark.createDataFrame([(1, "https://a.net/x", "m", "d"), (2, None, "m", "d")], "page_id long, url string, __url string, `a.b` string")
    got = U.judge(rows, queries.URL_RULES)
    assert got.columns[:4] == ["page_id", "url", "__url", "a.b"] and [tuple(r)[2:4] for r in got.collect()] == [("m", "d")] * 2
