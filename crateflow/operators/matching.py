"""Choosing among candidates: previews, downloads, responses of batched lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crateflow.functions import status, text
from crateflow.sources.tables import written

AVAILABLE_FROM = 0.60
#: Groups of up to so many distinct titles and durations are paired whole.
PAIRED = 64


def scored(pairs: DataFrame) -> DataFrame:
    """pairs with score and confidence.

    pairs: track_id, title, artist, duration_s, isrc and the candidate's c_title, c_artist, c_duration_s, c_isrc, url.
    """
    title, artist = text.token_overlap(F.col("title"), F.col("c_title")), text.token_overlap(F.col("artist"), F.col("c_artist"))
    length, isrc = text.duration_score(F.col("duration_s"), F.col("c_duration_s")), text.same_isrc(F.col("isrc"), F.col("c_isrc"))
    parts = pairs.withColumns({"__t": title, "__a": artist, "__d": length, "__i": isrc, "__p": text.title_penalty(F.col("c_title"))})
    score, sure = text.preview_score(F.col("__t"), F.col("__a"), F.col("__d"), F.col("__i"), F.col("__p"), F.col("url"))
    return parts.withColumns({"score": score, "confidence": sure, "isrc_exact": F.col("__i")}).drop("__t", "__a", "__d", "__i", "__p")


def best(candidates: DataFrame) -> DataFrame:
    """Per track the first candidate with its ISRC, else the first of the highest score; available from AVAILABLE_FROM with a url.

    candidates: as from scored(), with ordinal.
    """
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("isrc_exact"), F.desc("score"), "ordinal"))
    rows = candidates.withColumn("n", rank).where("n = 1").drop("n")
    fine = (F.coalesce("url", F.lit("")) != "") & (F.col("confidence") >= AVAILABLE_FROM)
    return rows.withColumn("status", F.when(fine, "available").otherwise("not_found"))


class _Range:
    """The two smallest ordinals of any range of rows in order of duration, by a table of least positions."""

    def __init__(self, duration: np.ndarray, ordinal: np.ndarray):
        at = np.lexsort((ordinal, duration))
        self.duration, self.ordinal, self.at = duration[at], ordinal[at], at
        self.levels = [np.arange(len(at))]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            low, step = self.levels[-1], 1 << len(self.levels) - 1
            a, b = low[:-step], low[step:]
            self.levels.append(np.where(self.ordinal[a] <= self.ordinal[b], a, b))

    def _least(self, lo: int, hi: int) -> int:
        level = (hi - lo).bit_length() - 1
        a, b = self.levels[level][lo], self.levels[level][hi - (1 << level)]
        return int(a if self.ordinal[a] <= self.ordinal[b] else b)

    def two(self, lo: int, hi: int) -> list[int]:
        if lo >= hi:
            return []
        p = self._least(lo, hi)
        rest = [self._least(*r) for r in ((lo, p), (p + 1, hi)) if r[0] < r[1]]
        return [p, min(rest, key=self.ordinal.__getitem__)] if rest else [p]

    def near(self, d: float) -> set[int]:
        """Rows among which are the two first by duration_score() against d, then by ordinal, however scores are rounded."""
        find = self.duration.searchsorted
        bounds = [(find(d - w, "left"), find(d + w, "right")) for w in (3_000, 10_000, 30_000)]
        found = {p for lo, hi in [*bounds, (0, len(self.at))] for p in self.two(int(lo), int(hi))}
        if bounds[0][1] - bounds[0][0] >= 2 and d < 60_000_000:
            return found
        zero_lo, zero_hi = int(find(0, "right")), int(find(2 * d, "left"))  # outside the score is 0
        found.update(self.two(0, min(zero_lo, int(bounds[2][0]))), self.two(max(zero_hi, int(bounds[2][1])), len(self.at)))
        alike = d * 0.0006 + 1  # durations that far apart differ by more than a rounded score
        at, end, n = int(bounds[2][1]), zero_hi, 0
        while at < end and n < 2:
            after = min(end, int(find(self.duration[at] + alike, "right")))
            found.update(range(at, after))
            at, n = after, n + after - at
        at, end, n = int(bounds[2][0]), zero_lo, 0
        while at > end and n < 2:
            before = max(end, int(find(self.duration[at - 1] - alike, "left")))
            found.update(range(before, at))
            at, n = before, n + at - before
        return found


def _near_in_group(points: pd.DataFrame) -> pd.DataFrame:
    """Candidates of each distinct (title, duration_ms) of a group. points: grp, title, key, penalty, duration_ms, ordinal."""
    whole: dict[tuple, list[tuple[_Range, bool, np.ndarray]]] = {}
    for by in (["penalty"], ["key", "penalty"]):
        for k, part in points.groupby(by, sort=False):
            for some in (part[part["duration_ms"].notna()], part[part["duration_ms"].isna()]):
                if len(some):
                    ranges = _Range(some["duration_ms"].fillna(0).to_numpy(float), some["ordinal"].to_numpy())
                    whole.setdefault(k[:-1], []).append((ranges, some["duration_ms"].isna().iloc[0], some.index.to_numpy()))
    mine, theirs = [], []
    distinct = points.drop_duplicates(["title", "duration_ms"])
    for i, key, d in zip(distinct.index, distinct["key"], distinct["duration_ms"], strict=True):
        for ranges, blank, index in [*whole[()], *whole[(key,)]]:
            found = ranges.near(float(d)) if d > 0 and not blank else ranges.two(0, len(index))
            theirs += index[ranges.at[sorted(found)]].tolist()
        mine += [i] * (len(theirs) - len(mine))
    a, b = points.loc[mine].reset_index(drop=True), points.loc[theirs].reset_index(drop=True)
    out = pd.DataFrame({"grp": a["grp"], "title": a["title"], "duration_ms": a["duration_ms"], "ordinal": b["ordinal"], "key": a["key"], "c_key": b["key"], "penalty": b["penalty"], "c_ms": b["duration_ms"]})
    return out.drop_duplicates()


def best_in_group(tracks: DataFrame) -> DataFrame:
    """best() for every track among all others of its group, without the pairs of the group.

    tracks: track_id, grp, title (one token), duration_ms, isrc; artists agree within a group, all have a url. Tracks with
    the ISRC come by a join, of each ISRC the two smallest ids. Without one, the score depends on whether the title
    agrees, its penalty and the durations; so each distinct title and duration gets a few candidates that hold its two best
    (one may be the track itself). Of groups over PAIRED, the
    distinct titles and durations are held in one task, never their pairs.
    """
    t = tracks.select("track_id", "grp", "title", F.col("duration_ms").cast("double").alias("duration_ms"), F.upper(F.trim("isrc")).alias("code")).where(F.col("grp").isNotNull())

    def two(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("track_id"))
        return rows.withColumn("n", rank).where("n <= 2").drop("n").withColumnRenamed("track_id", "ordinal")

    coded = two(t.where("code <> ''"), "grp", "code").select("grp", "code", "ordinal")
    exact = t.join(coded, ["grp", "code"]).where("track_id <> ordinal").withColumns({"score": F.lit(1.0), "confidence": F.lit(1.0), "isrc_exact": F.lit(True)})
    key = F.array_join(F.array_sort(F.array_distinct(text.tokens(F.col("title")))), " ")
    points = two(t.drop("code"), "grp", "title", "duration_ms").select("grp", F.coalesce("title", F.lit("")).alias("title"), key.alias("key"), text.title_penalty(F.col("title")).alias("penalty"), "duration_ms", "ordinal").fillna("", ["key"])
    sized = points.join(points.groupBy("grp").agg(F.count("*").alias("m")), "grp")
    other = points.select("grp", "ordinal", F.col("key").alias("c_key"), "penalty", F.col("duration_ms").alias("c_ms"))
    small = sized.where(F.col("m") <= PAIRED).select("grp", "title", "duration_ms", "key").distinct().join(other, "grp")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    large = sized.where(F.col("m") > PAIRED).drop("m").groupBy("grp").applyInPandas(_near_in_group, f"grp {kinds['grp']}, title string, duration_ms double, ordinal {kinds['ordinal']}, key string, c_key string, penalty double, c_ms double")
    near = small.unionByName(large)
    parts = F.split("key", " "), F.split("c_key", " ")  # made once a title; scored() makes them once a pair
    alike = text.shared(*[F.filter(x, lambda v: v != "") for x in parts])
    length = text.duration_score(F.col("duration_ms") / 1000, F.col("c_ms") / 1000)
    score, sure = text.preview_score(alike, F.lit(1.0), length, F.lit(False), F.col("penalty"), F.lit("u"))
    judged = near.withColumns({"score": score, "confidence": sure, "isrc_exact": F.lit(False)})
    rank = F.row_number().over(Window.partitionBy("grp", "title", "duration_ms").orderBy(F.desc("score"), "ordinal"))
    firsts = judged.withColumn("n", rank).where("n <= 2").select(F.col("grp").alias("g"), F.col("title").alias("l"), F.col("duration_ms").alias("d"), "ordinal", "score", "confidence", "isrc_exact")
    same = (F.col("grp") == F.col("g")) & (F.coalesce("title", F.lit("")) == F.col("l")) & F.col("duration_ms").eqNullSafe(F.col("d"))
    fuzzy = t.join(firsts, same).where("track_id <> ordinal")
    columns = ["track_id", "ordinal", "score", "confidence", "isrc_exact"]
    return best(exact.select(columns).unionByName(fuzzy.select(columns)).withColumn("url", F.lit("u")))


def _bounded(candidates: DataFrame) -> DataFrame:
    """Candidates within the allowed duration, with the most that each can score; texts are normalised once."""
    rows = candidates.withColumns({"__a": text.normalize_blanks(F.col("text")), "__b": text.normalize_blanks(F.col("c_text"))})
    most = text.download_score(text.ratio_bound(F.col("__a"), F.col("__b")), F.col("duration_s"), F.col("c_duration_s"))
    return rows.withColumn("bound", most).where(F.col("bound").isNotNull())


def best_downloads(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the best candidate of each track with its score, all candidates whose texts were compared).

    candidates: track_id, ordinal, text, duration_s and the candidate's c_text, c_duration_s. Those too long or too short go
    first. The comparison runs in Python, so it sees only candidates that can still win: of each track the one of the
    highest bound, then those whose bound isn't below its score. Equal scores go to the smaller ordinal.
    """
    rows = written(_bounded(candidates))

    def compared(some: DataFrame) -> DataFrame:
        score = text.download_score(text.sequence_ratio(F.col("__a"), F.col("__b")), F.col("duration_s"), F.col("c_duration_s"))
        return some.withColumn("score", score).select("track_id", "ordinal", "score")

    order = Window.partitionBy("track_id").orderBy(F.desc("bound"), "ordinal")
    first = written(compared(rows.withColumn("n", F.row_number().over(order)).where("n = 1")))
    floors = first.select("track_id", F.col("ordinal").alias("__first"), F.col("score").alias("__floor"))
    more = rows.join(floors, "track_id").where((F.col("ordinal") != F.col("__first")) & (F.col("bound") >= F.col("__floor") - 1e-12))
    every = written(first.unionByName(compared(more)))
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("score"), "ordinal"))
    return every.withColumn("n", rank).where("n = 1").drop("n"), every


def ranked(candidates: DataFrame, viable: float = 0.5) -> DataFrame:
    """Download candidates in order: confidence (high first), then as listed; the best viable one first and selected.

    Of candidates with one url the first stays. candidates: track_id, ordinal, url, confidence.
    """
    order = Window.partitionBy("track_id").orderBy(F.desc("confidence"), "ordinal")
    once = F.row_number().over(Window.partitionBy("track_id", "url").orderBy(F.desc("confidence"), "ordinal"))
    rows = candidates.withColumn("n", once).where("n = 1").drop("n").withColumn("rank", F.row_number().over(order) - 1)
    return rows.withColumn("is_selected", (F.col("rank") == 0) & (F.col("confidence") >= viable))


def rekeyed(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """request_id and the payload that answers it, matched by id, then ISRC, then the id in the link; a later answer wins.

    requests: request_id; responses: ordinal, id, isrc, href, payload.
    """
    keys = F.array(*[F.struct(F.lit(k).alias("turn"), c.alias("key")) for k, c in enumerate((F.col("id"), F.col("isrc"), text.id_from_url(F.col("href"))))])
    named = responses.select("ordinal", "payload", F.explode(keys).alias("k")).where("k.key is not null").select("ordinal", "payload", "k.turn", "k.key")
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("turn", F.desc("ordinal")))
    return requests.join(named, F.col("request_id") == F.col("key")).withColumn("n", rank).where("n = 1").select("request_id", "payload")


#: Members of an answer that may hold its list of items.
ITEM_LISTS = ("content", "audioFeatures")


def payload_items(answers: DataFrame, column: str = "payload") -> DataFrame:
    """answers with a row per item of their JSON payloads (item, as JSON text): a list's elements, those of a list member, or the object itself.

    Only objects are items; a malformed payload, or one of another kind, has none. Names of columns are free.
    """
    kept = answers.columns
    parsed = answers.withColumn("__v", F.try_parse_json(column))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    within = F.lit(None).cast("variant")
    for name in reversed(ITEM_LISTS):
        member = F.try_variant_get("__v", f"$.{name}", "variant")
        within = F.when(kind(member).startswith("ARRAY"), member).otherwise(within)
    found = F.when(kind(F.col("__v")).startswith("ARRAY"), F.col("__v")).when(kind(F.col("__v")).startswith("OBJECT"), within)
    single = F.when(kind(F.col("__v")).startswith("OBJECT"), F.array(F.col("__v")))
    items = F.coalesce(F.try_variant_get(found, "$", "array<variant>"), single)
    rows = parsed.select(*kept, F.posexplode(items).alias("place", "__item"))
    return rows.where(kind(F.col("__item")).startswith("OBJECT")).select(*kept, "place", F.to_json("__item").alias("item"))


def request_batches(ids: DataFrame, size: int = 40) -> DataFrame:
    """ids in batches of `size` by order of id: batch, request_ids. Batches are cut within ranges of ids, so no task numbers all."""
    part = ids.select("request_id").distinct().repartitionByRange("request_id").withColumn("__p", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("__p").orderBy("request_id")) - 1
    return part.withColumn("__b", F.floor(place / size)).groupBy("__p", "__b").agg(F.array_sort(F.collect_list("request_id")).alias("request_ids")).select("request_ids")


def audited(previews: DataFrame, least: float = AVAILABLE_FROM) -> DataFrame:
    """Adds the verdict and whether it asks for a remedy. previews: isrc_unresolvable, mismatch, fuzzy, confidence."""
    verdict = status.audit_verdict(F.col("isrc_unresolvable"), F.col("mismatch"), F.col("fuzzy"), F.col("confidence"), least)
    return previews.withColumn("verdict", verdict).withColumn("needs_remedy", F.col("verdict").isin("mismatch", "low_confidence_fuzzy"))


def verdict_counts(audited_: DataFrame) -> DataFrame:
    """How many rows of audited() have each verdict, and whether it asks for a remedy."""
    return audited_.groupBy("verdict").agg(F.count("*").alias("n"), F.bool_or("needs_remedy").alias("needs_remedy"))
