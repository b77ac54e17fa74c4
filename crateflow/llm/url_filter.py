"""URL filtering by rules, and where no rule fits by a ratio of character language models, in DataFrame operations alone.

The URLs that a rule allows and those that a rule blocks train one variable-order Markov model each: the next character
given up to ORDER characters before it, where each context length is smoothed with the shorter one (Witten-Bell: the
shorter context weighs as much as the context has different next characters). A URL's value is the difference of the
two models' log probabilities, divided by its length. A fifth of the rules' URLs (by hash) is kept from training and
gives the threshold: the value that parts the allowed from the blocked ones with the best mean of both recalls.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.runtime import durable

ORDER = 4
#: Probability of a character that no context has seen.
LEAST = 1 / 256
START, END = "\x02", "\x03"
#: Log ratios are sums of whole millionths, so that no order of summing matters; thresholds are tried in steps of STEP.
UNIT, STEP = 1_000_000, 10_000
FOLDS = 5


@dataclass(frozen=True)
class UrlRule:
    """Fits host and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest fitting rule's name, else null; of two equally long ones the first of `rules`."""
    found = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):  # the last one that fits is what stays
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.name)).otherwise(found)
    return found


def _windows(url: Column) -> Column:
    """For every character and the end, the ORDER characters before it and itself."""
    padded = F.concat(F.lit(START * ORDER), url, F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))."), F.lit(1))


def fold_of(url: Column) -> Column:
    return F.conv(F.substring(F.md5(url.cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS


def ratios(grams: DataFrame) -> DataFrame:
    """(gram, llr): the log ratio, in UNITs, of a window's last character after the others. grams: gram, a, b (training counts)."""
    last: DataFrame | None = None
    for k in range(1, ORDER + 2):
        here = grams.groupBy(F.substring("gram", ORDER + 2 - k, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        here = here.withColumn("ctx", F.substring("g", 1, k - 1))
        after = here.groupBy("ctx").agg(*[f(c) for c in "ab" for f in (lambda c: F.sum(c).alias(f"n{c}"), lambda c: F.sum(F.expr(f"int({c} > 0)")).alias(f"t{c}"))])
        here = here.join(after, "ctx")
        if last is None:
            here = here.withColumn("qa", F.lit(LEAST)).withColumn("qb", F.lit(LEAST))
        else:
            here = here.withColumn("s", F.substring("g", 2, k - 1)).join(last, "s")
        p = {c: F.expr(f"if(n{c} = 0, q{c}, (double({c}) + double(t{c}) * q{c}) / (double(n{c}) + double(t{c})))") for c in "ab"}
        last = here.select(F.col("g").alias("s"), p["a"].alias("qa"), p["b"].alias("qb"))
    return last.select(F.col("s").alias("gram"), F.round((F.log("qa") - F.log("qb")) * UNIT).cast("long").alias("llr"))


def judge(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url") -> DataFrame:
    """Adds host, path, rule, value (log ratio per character, in UNITs), threshold and verdict (allow or block).

    A null URL, or one without ://, has an empty host and path; null counts as the empty URL, whose value comes from its
    end alone. A value at the threshold or above is allowed. Without rules' URLs to learn from all values are 0, and
    without both kinds among those kept back the threshold is 0. Repeated rows get the same verdict; a URL is read
    whole; columns named as the new ones are replaced; an empty table gives an empty table.
    """
    verdicts = {r.name: r.verdict for r in rules}
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "value", "threshold", "verdict")]
    marked = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("__url"))
    ruled = rule_of(host_of(F.col("__url")), path_of(F.col("__url")), rules)

    def verdict_of(rule: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, verdict in verdicts.items():
            found = F.when(rule == name, F.lit(verdict)).otherwise(found)
        return found

    urls = marked.groupBy("__url").agg(F.count("*").alias("n"))
    urls = durable(urls.select(F.col("__url").alias("u"), "n", verdict_of(ruled).alias("known"), fold_of(F.col("__url")).alias("fold")))
    spots = urls.repartition("u").select("u", "n", "known", "fold", F.explode(_windows(F.col("u"))).alias("gram"))  # dealt, as the table may be one file
    trains = F.col("fold") != 0
    count = {v: F.coalesce(F.sum(F.when(trains & (F.col("known") == v), F.col("n"))), F.lit(0)) for v in ("allow", "block")}
    grams = durable(spots.groupBy("gram").agg(count["allow"].alias("a"), count["block"].alias("b")))  # all context lengths read these
    model = durable(ratios(grams))
    values = spots.select("u", "gram").join(model, "gram").groupBy("u").agg(F.sum("llr").alias("sum"), F.count("*").alias("len"))
    valued = durable(values.select("u", F.floor(F.col("sum").cast("double") / F.col("len")).cast("long").alias("value")))
    held = urls.where("fold = 0 and known is not null").join(valued, "u")
    steps = held.groupBy(F.floor(F.col("value") / STEP).cast("long").alias("step")).agg(*[F.coalesce(F.sum(F.when(F.col("known") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("allow", "block")])
    threshold = best_threshold([(r["step"], r["allow"], r["block"]) for r in steps.collect()])  # log ratios per character are within 2 * log(256 * length) / STEP steps
    out = marked.join(valued.withColumnRenamed("u", "__u"), F.col("__url") == F.col("__u"), "left")
    out = out.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url"))}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("threshold", F.lit(threshold).cast("long"))
    decided = F.coalesce(verdict_of(F.col("rule")), F.when(F.col("value") >= F.col("threshold"), "allow").otherwise("block"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", "rule", "value", "threshold", decided.alias("verdict"))


def best_threshold(steps: list[tuple[int, int, int]]) -> int:
    """From (step, allowed, blocked) the threshold with the best sum of recalls; of several the one nearest 0, then the lower."""
    allowed, blocked = sum(a for _, a, _ in steps), sum(b for _, _, b in steps)
    if not allowed or not blocked:
        return 0
    options = sorted({s for s, _, _ in steps} | {s + 1 for s, _, _ in steps} | {0})
    gains = [(sum(a for s, a, _ in steps if s >= t) * blocked + sum(b for s, _, b in steps if s < t) * allowed, -abs(t), -t) for t in options]
    return -max(gains)[2] * STEP
