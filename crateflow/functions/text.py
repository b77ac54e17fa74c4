"""Text normalisation and similarity as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Latin letters with marks and what decomposition leaves of them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def plain(text: str) -> str:
    """Lower case, compatibility decomposition, without marks."""
    import unicodedata

    return "".join(x for x in unicodedata.normalize("NFKD", text.lower()) if unicodedata.category(x) != "Mn")


@F.pandas_udf(StringType())
def _plain(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else plain(t) for t in text], dtype=object)


def plain_letters(c: Column) -> Column:
    """plain() of a column: Latin letters with marks by table and combining marks by class, only what is left beyond ASCII by the function itself."""
    quick = F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), r"\p{Mn}", "")
    return F.coalesce(_plain(F.when(quick.rlike(r"[^\x00-\x7F]"), quick)), quick)


def normalize(c: Column) -> Column:
    """Search form: lower, unmarked, blanks collapsed and trimmed; null becomes the empty string."""
    return F.trim(F.regexp_replace(plain_letters(F.coalesce(c, F.lit(""))), r"\s+", " "))


def normalize_for_match(c: Column) -> Column:
    """Match form: as normalize(), with everything but word characters and blanks as a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(plain_letters(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_for_match(c), " "), lambda t: t != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token set; 0 if either is empty."""
    return shared(tokens(a), tokens(b))


def shared(x: Column, y: Column) -> Column:
    """token_overlap() of two token sets."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which no built-in expresses."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def ratio_bound(a: Column, b: Column) -> Column:
    """What sequence_ratio() cannot exceed: twice the characters that both have, however placed, over all of both."""
    x, y = (F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda v: v != "") for c in (a, b))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, v: n + F.least(F.size(F.filter(x, lambda u: u == v)), F.size(F.filter(y, lambda u: u == v))))
    both = F.size(x) + F.size(y)
    return F.when(both == 0, 1.0).otherwise(2.0 * common / both)


def text_match(a: Column, b: Column) -> Column:
    return sequence_ratio(normalize_blanks(a), normalize_blanks(b))


def duration_score(expected: Column, found: Column) -> Column:
    """1 within 3 seconds, .85 within 10, .6 within 30, then by the share of the expected length; .5 if unknown."""
    off = F.abs(expected - found)
    late = F.greatest(F.lit(0.0), 1 - off / expected)
    return F.when(expected.isNull() | found.isNull() | (expected <= 0), 0.5).when(off <= 3, 1.0).when(off <= 10, 0.85).when(off <= 30, 0.6).otherwise(late)


#: Words in a title that tell another version, and how much each costs.
VERSION_PENALTIES = {"live": 0.25, "remix": 0.15, "karaoke": 0.40, "instrumental": 0.20, "acoustic": 0.05, "cover": 0.10}
MOST_PENALTY = 0.6


def title_penalty(title: Column) -> Column:
    total = F.lit(0.0)
    for word, cost in VERSION_PENALTIES.items():
        total = total + F.when(F.coalesce(title, F.lit("")).rlike(rf"(?i)\b{word}\b"), cost).otherwise(0.0)
    return F.least(total, F.lit(MOST_PENALTY))


def same_isrc(a: Column, b: Column) -> Column:
    return F.coalesce((F.upper(F.trim(a)) == F.upper(F.trim(b))) & (F.trim(a) != ""), F.lit(False))


def preview_score(title: Column, artist: Column, duration: Column, isrc: Column, penalty: Column, url: Column) -> tuple[Column, Column]:
    """(score, confidence) of a candidate from its part scores; isrc is boolean, and with a url it decides alone."""
    raw = 0.45 * title + 0.35 * artist + 0.20 * duration + F.when(isrc, 0.35).otherwise(0.0) - penalty
    held, linked = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.coalesce(url, F.lit("")) != ""
    sure = F.when((title < 0.3) | (artist < 0.3), held * 0.5).otherwise(held)
    return F.when(isrc & linked, 1.0).otherwise(F.round(held, 4)), F.when(~linked, 0.0).when(isrc, 1.0).otherwise(F.round(sure, 4))


def download_score(text: Column, expected: Column, found: Column, most_off: float = 15.0) -> Column:
    """.7 text and .3 duration; null if the durations are further apart than allowed."""
    off = F.abs(expected - found)
    near = F.greatest(F.lit(0.0), 1 - off / F.greatest(expected, F.lit(1.0)))
    return F.when(off <= most_off, 0.7 * text + 0.3 * near)


def fingerprint(id_: Column, title: Column, artists: Column, album: Column, duration: Column) -> Column:
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (id_, title, F.array_join(F.array_sort(artists), ","), album, duration)]
    return F.concat_ws("|", *text)


def label_of(c: Column, names: dict[str, str]) -> Column:
    """The listed label, else the code in words."""
    found = F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    for code, name in names.items():
        found = F.when(c == code, name).otherwise(found)
    return found


def id_from_url(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"track/([A-Za-z0-9]+)", 1), F.lit("")), F.nullif(F.element_at(F.split(F.parse_url(url, F.lit("PATH")), "/"), -1), F.lit("")))


def valid_name(c: Column) -> Column:
    return c.rlike(r"^[^\x00-\x1f\x7f]{1,100}$")


def iso(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def from_iso(c: Column) -> Column:
    """ISO time with Z or an offset as a naive UTC time; the session's zone must be UTC."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")
