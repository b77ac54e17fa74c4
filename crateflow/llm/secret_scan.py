"""Secret scanning with a trigram inverted index, in DataFrame operations alone.

Each rule's regular expression gives a Boolean trigram query: an AND of clauses, each an OR of strings that a match must
contain, each string an AND of its trigrams. The index has a posting (trigram, text) for every trigram of any rule's
query that occurs in the lower-cased text. Counting a text's postings by string and clause intersects them; the texts
that satisfy a rule's query are its candidates, and only they are matched against its expression. A rule whose expression
has no mandatory trigram is matched against every text. One pass over a text finds all of its postings.

Positions come from the lengths of the matches and of the pieces between them, summed over each text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.llm.runtime import durable

#: More strings than this make no clause of their own: the OR would hardly select anything.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least `least` characters; others are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three basic kinds, in the order in which spans that start together are listed.
BASE_RULES = (
    Rule("assign", rf"""({"|".join(map(either_case, ("password", "passwd", "secret", "token")))}|{either_case("api")}_?{either_case("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
#: Further kinds that are told by their form.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=,:.\\\x20\x09-\x0D-]*?-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("forge_token", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("map_key", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("login_url", r"[a-z]+://[A-Za-z0-9._-]+:[^\x00-\x20/@:]+@"),
)


def trigram_query(pattern: str) -> list[list[str]]:
    """The clauses of the Boolean query: lower-cased strings of three characters or more, one of which each match contains."""
    from re import _parser as parser

    def several(nodes) -> tuple[set[str] | None, list[list[str]]]:
        """The strings that the nodes match, if they are few (else None), and clauses that hold for any match."""
        found: list[list[str]] = []
        current, exact = {""}, True

        def flush() -> None:
            if min(map(len, current)) >= 3:
                found.append(_shortest(current))

        for op, value in nodes:
            strings, clauses = single(str(op), value)
            found.extend(clauses)
            if strings is not None and len(current) * len(strings) <= MOST_STRINGS:
                current = {a + b for a in current for b in strings}
            else:
                flush()
                exact, current = False, strings or {""}
        if exact:
            return current, found
        flush()
        return None, found

    def single(op: str, value) -> tuple[set[str] | None, list[list[str]]]:
        if op == "LITERAL":
            return {chr(value).lower()}, []
        if op == "IN":
            letters = {chr(v).lower() for o, v in value if str(o) == "LITERAL"}
            return (letters, []) if all(str(o) == "LITERAL" for o, _ in value) and len(letters) <= 8 else (None, [])
        if op == "SUBPATTERN":
            return several(value[3])
        if op == "BRANCH":
            parts = [several(branch) for branch in value[1]]
            if all(s is not None for s, _ in parts):
                return set().union(*(s for s, _ in parts)), []
            sets = [sorted(s) if s is not None else (c[0] if c else None) for s, c in parts]
            whole = [x for s in sets if s for x in s]
            return None, [_shortest(set(whole))] if all(sets) and all(len(x) >= 3 for x in whole) and len(whole) <= MOST_STRINGS else []
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = value
            strings, clauses = several(body)
            if low == high == 1:
                return strings, clauses
            if low == 0:
                return ({"", *strings}, []) if strings is not None and high == 1 else (None, [])
            return None, clauses + ([_shortest(strings)] if strings and min(map(len, strings)) >= 3 else [])
        return None, []

    strings, clauses = several(parser.parse(pattern))
    if strings is not None and min(map(len, strings)) >= 3:
        clauses = [*clauses, _shortest(strings)]
    return clauses


def _shortest(strings: set[str]) -> list[str]:
    """Without those that contain another one: the OR is the same."""
    return sorted(a for a in strings if not any(b != a and b in a for b in strings))


def trigrams(word: str) -> list[str]:
    return sorted({word[k : k + 3] for k in range(len(word) - 2)})


def _pattern(rule: Rule) -> str:
    """The expression; a plain run of one class with a least length may ask for that length at once."""
    if rule.group == 0 and rule.least and (m := re.fullmatch(r"([A-Za-z]*)(\[[^\]]+\])\+", rule.pattern)) and not re.search("[^A-Z0-9]", m[1]):
        return f"{m[1]}{m[2]}{{{rule.least - len(m[1])},}}"
    return rule.pattern


def anywhere(words: Sequence[str]) -> str:
    """An expression whose group 1 is, at each place of a text, the one of these trigrams that begins there.

    It looks ahead, so overlapping ones are found too, and branches by letter, so a place costs about one comparison a letter.
    """
    tree: dict[str, dict[str, set[str]]] = {}
    for a, b, c in words:
        tree.setdefault(a, {}).setdefault(b, set()).add(c)
    any_of = lambda letters: "[" + "".join(map(re.escape, sorted(letters))) + "]"
    branches = [re.escape(a) + "(?:" + "|".join(re.escape(b) + any_of(last) for b, last in sorted(after.items())) + ")" for a, after in sorted(tree.items())]
    return f"(?={any_of(tree)})(?=({'|'.join(branches)}))"


def index(docs: DataFrame, rules: Sequence[Rule], key: Sequence[str], text: str) -> DataFrame:
    """A row per text: its key and the indexed trigrams it contains. Exploded, these are the postings."""
    vocabulary = sorted({t for rule in rules for clause in trigram_query(rule.pattern) for word in clause for t in trigrams(word)})
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    present = F.array_distinct(F.regexp_extract_all(low, F.lit(anywhere(vocabulary)), F.lit(1))) if vocabulary else F.array().cast("array<string>")
    return docs.select(*key, present.alias("present"))


def candidates(marks: DataFrame, rules: Sequence[Rule], key: Sequence[str]) -> DataFrame:
    """A row per text that satisfies a rule's query: its key and those rules' kinds. marks: as from index()."""
    terms = [(rule.kind, c, f"{c}:{word}", t, len(trigrams(word)), len(trigram_query(rule.pattern))) for rule in rules for c, clause in enumerate(trigram_query(rule.pattern)) for word in clause for t in trigrams(word)]
    spark = marks.sparkSession
    wanted = spark.createDataFrame(terms, "kind string, clause int, word string, trigram string, n_trigrams int, n_clauses int")
    postings = marks.select(*key, F.explode("present").alias("trigram")).distinct()
    words = postings.join(F.broadcast(wanted), "trigram").groupBy(*key, "kind", "n_clauses", "clause", "word", "n_trigrams").agg(F.count("*").alias("n")).where("n = n_trigrams")
    met = words.groupBy(*key, "kind", "n_clauses").agg(F.count_distinct("clause").alias("n")).where("n = n_clauses")
    return met.groupBy(*key).agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, text: Column) -> Column:
    """An array with, for each match, the length of the piece before it, its own, and that of the group that counts."""
    pattern = F.lit(_pattern(rule))
    pieces, whole = F.split(text, _pattern(rule), -1), F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("a"), whole.alias("b"), group.alias("c"))
    return F.transform(zipped, lambda x: F.struct(F.length(x["a"]).alias("before"), F.length(x["b"]).alias("size"), F.length(x["c"]).alias("counted")))


def find(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(marks, spans): marks has a row per input row with its key (__id, __hash), spans a row per distinct key and match.

    spans: __id, __hash, kind, position (of the kind among the rules), start, end (code points, end exclusive). Null
    texts are empty. Rows with the same id and text share one key. An empty table gives two empty ones.
    """
    key = ["__id", "__hash"]
    keyed = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__hash"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    scanned = [r for r in rules if not trigram_query(r.pattern)]
    marks = durable(index(keyed, indexed, key, "__text"))
    chosen = durable(candidates(marks, indexed, key)).withColumnsRenamed({"__id": "__i", "__hash": "__h"})
    order = {r.kind: k for k, r in enumerate(rules)}

    def hits(rows: DataFrame, some: Sequence[Rule], asked: bool) -> DataFrame:
        found = [F.when((F.array_contains("kinds", r.kind) if asked else F.lit(True)) & F.col("__text").rlike(_pattern(r)), F.struct(F.lit(order[r.kind]).alias("position"), F.lit(r.least).alias("least"), _matches(r, F.col("__text")).alias("matches"))) for r in some]
        return rows.select(*key, F.explode(F.array_compact(F.array(*found))).alias("hit")).select(*key, "hit.*")

    parts = []
    if scanned:
        parts.append(hits(keyed, scanned, False))
    if indexed:
        near = keyed.join(chosen, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h"))).drop("__i", "__h")
        parts.append(hits(near, indexed, True))
    all_ = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = all_.dropDuplicates([*key, "position"]).select(*key, "position", "least", F.posexplode("matches").alias("n", "m"))
    running = F.sum(F.expr("m.before + m.size")).over(Window.partitionBy(*key, "position").orderBy("n"))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("position") + 1)
    spans = rows.withColumn("end", running).where("m.counted >= least").select(*key, kind.alias("kind"), "position", (F.col("end") - F.col("m.size")).alias("start"), "end")
    return marks.select(*key), spans


def listed(spans: Column) -> Column:
    """kind:start:end of an array of (start, position, kind, end), in that order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, base: Sequence[Rule] = BASE_RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per input row: doc_id, a count n_<kind> for each base rule, base_sha256 and spans.

    base_sha256 is over the list of the base rules' spans, spans lists all of them; both lists are empty where there
    is no match.
    """
    key = ["__id", "__hash"]
    marks, spans = find(docs, rules, text, doc_id)
    spot = F.struct("start", "position", "kind", "end")
    grouped = spans.groupBy(*key).agg(
        *[F.sum(F.expr(f"int(kind = '{r.kind}')")).alias(f"n_{r.kind}") for r in base],
        F.collect_list(F.when(F.col("position") < len(base), spot)).alias("basic"),
        F.collect_list(spot).alias("all"),
    ).withColumnsRenamed({"__id": "__i", "__hash": "__h"})
    joined = marks.join(grouped, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
    none = F.lit("")
    return joined.select(
        F.col("__id").alias("doc_id"),
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(F.coalesce(listed(F.col("basic")), none).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("all")), none).alias("spans"),
    )


def redact(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, mask: str = "[secret]", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the matches that find() counts replaced by the mask; null texts stay null, other columns stay.

    Only texts with spans are rewritten, and only by the rules that found them, in the rules' order and with their least
    lengths in the expressions. Rows are carried whole, so no column's name can clash. Repeated rows are rewritten alike; an
    empty table gives an empty table.
    """
    _, spans = find(docs, rules, text, doc_id)
    kinds = durable(spans.groupBy("__id", "__hash").agg(F.collect_set("kind").alias("kinds")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))
    joined = whole.join(kinds, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left")
    steps = F.filter(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(_counted(r)).alias("pattern")) for r in rules]), lambda r: F.array_contains("kinds", r["kind"]))
    masked = F.aggregate(steps, F.col("text"), lambda held, r: F.regexp_replace(held, r["pattern"], F.lit(mask)))  # one expression, however many the rules
    return joined.select(*[F.when(F.col("kinds").isNull(), F.col("text")).otherwise(masked).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def _counted(rule: Rule) -> str:
    """The expression with the least length of what counts."""
    return rule.pattern[: rule.pattern.rindex("+)")] + f"{{{rule.least},}})" if rule.group else _pattern(rule)
