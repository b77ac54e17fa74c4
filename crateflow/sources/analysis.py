"""Documents of an audio analysis tool, parsed once into VARIANT: a number may be a number, a list, or an object with its mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the twelve keys, sharps and flats, and of the scales.
KEYS = {"c": 0, "c#": 1, "db": 1, "d": 2, "d#": 3, "eb": 3, "e": 4, "f": 5, "f#": 6, "gb": 6, "g": 7, "g#": 8, "ab": 8, "a": 9, "a#": 10, "bb": 10, "b": 11}
SCALES = {"minor": 0, "min": 0, "major": 1, "maj": 1}
#: The members of an object that may hold its number, after `mean`; the blocks that may hold a key.
OTHER_MEANS = ("value", "avg", "average")
KEY_BLOCKS = ("key_edma", "key_krumhansl", "key_temperley")
#: The confidence of a tempo that comes without one.
TEMPO_CONFIDENCE = 0.85

_NODES = {
    "rhythm": ("bpm", "bpm_confidence", "perceptual_tempo", "beats_loudness", "onset_rate", "beats_count"),
    "lowlevel": ("loudness", "average_loudness", "mfcc", "hpcp", "spectral_contrast", "spectral_centroid", "spectral_rolloff", "dynamic_complexity", "onset_rate"),
    "tonal": ("key_key", "key", "key_scale", "scale", "key_strength", "key_confidence", "hpcp", *KEY_BLOCKS),
}
#: Members of a key block, and where the plain members for them stand.
_KEYED = {"key": ("key_key", "key"), "scale": ("key_scale", "scale"), "strength": ("key_strength", "key_confidence")}


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def _is(v: Column, *kinds: str) -> Column:
    """Whether a node is of one of these kinds; false if it isn't there."""
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({'|'.join(kinds)})"), F.lit(False))


_NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


def _plain(v: Column) -> Column:
    return F.when(_is(v, *_NUMBERS), _get(v, "", "double"))


def _elements(v: Column) -> Column:
    """The numbers of a list, its other elements left out; null for other nodes."""
    return F.filter(F.transform(_get(v, "", "array<variant>"), _plain), lambda x: x.isNotNull())


def _mean(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))


def number(v: Column) -> Column:
    """The number of a node: itself; of an object its mean (a number, or a list's mean), value, avg or average; a list's mean.

    Other nodes than objects have no members and other nodes than lists no elements, so only numbers are told apart by their kind.
    """
    inner = _get(v, "mean")
    of_object = F.coalesce(_plain(inner), _mean(_elements(inner)), *[_plain(_get(v, name)) for name in OTHER_MEANS])
    return F.coalesce(_plain(v), _mean(_elements(v)), of_object)


def _vector(v: Column) -> Column:
    """The list of an object's mean; an empty one if there is none."""
    return F.coalesce(_elements(_get(v, "mean")), F.array().cast("array<double>"))


def _filled(v: Column) -> Column:
    """Whether a node counts as given: 0, false, nulls and what is empty don't."""
    empty = F.coalesce(_plain(v) == 0, F.lit(False)) | F.coalesce(F.to_json(v).isin("null", "false", '""', "[]", "{}"), F.lit(False))
    return v.isNotNull() & ~empty


def _either(*nodes: Column) -> Column:
    """The first node that is given, else the last."""
    found = nodes[-1]
    for v in reversed(nodes[:-1]):
        found = F.when(_filled(v), v).otherwise(found)
    return found


def _named(v: Column, table: dict[str, int]) -> Column:
    """A name's number by the table; a whole number is taken as it is."""
    name = F.when(_is(v, "STRING"), F.trim(F.lower(_get(v, "", "string"))))
    numbers = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(numbers[name], F.when(_is(v, "BIGINT", "INT", "SMALLINT", "TINYINT"), _get(v, "", "int")))


def analysis_documents(documents: DataFrame, column: str = "value") -> DataFrame:
    """documents with their measures as columns; malformed documents and those that are no object give nulls, absent vectors are empty.

    A loudness or onset rate of 0 yields to the other place where it may stand. A tempo without confidence has
    TEMPO_CONFIDENCE. Of the key blocks the first object counts, for what the plain members leave open.
    """
    kept = documents.columns
    parsed = documents.withColumn("__d", F.try_parse_json(column)).withColumn("__d", F.when(_is(F.col("__d"), "OBJECT"), F.col("__d")))
    nodes = parsed.select(*kept, "__d", *[_get(F.col("__d"), f"{part}.{name}").alias(f"__{part}_{name}") for part, names in _NODES.items() for name in names])
    n = lambda part, name: F.col(f"__{part}_{name}")
    block = F.coalesce(*[F.when(_is(n("tonal", b), "OBJECT"), n("tonal", b)) for b in KEY_BLOCKS])
    picked = nodes.select(
        *kept, "__d", block.alias("__block"), _either(n("lowlevel", "loudness"), n("lowlevel", "average_loudness")).alias("__loudness"), _either(n("lowlevel", "onset_rate"), n("rhythm", "onset_rate")).alias("__onset"),
        _either(n("lowlevel", "hpcp"), n("tonal", "hpcp")).alias("__hpcp"), *[n("rhythm", x).alias(f"__{x}") for x in ("bpm", "bpm_confidence", "perceptual_tempo", "beats_loudness", "beats_count")],
        *[n("lowlevel", x).alias(f"__{x}") for x in ("mfcc", "spectral_contrast", "spectral_centroid", "spectral_rolloff", "dynamic_complexity")],
        *[_either(n("tonal", first), n("tonal", second)).alias(f"__own_{member}") for member, (first, second) in _KEYED.items()],
    )
    c = lambda name: F.col(f"__{name}")
    # each choice is a column before it is used again: inlined, its expression would be repeated at every use
    chosen = picked.withColumns({f"__of_{m}": F.when(c("block").isNotNull(), _get(c("block"), m)) for m in _KEYED})
    keyed = {f"__{m}": F.when(c("block").isNotNull() & ~_filled(c(f"own_{m}")), c(f"of_{m}")).otherwise(c(f"own_{m}")) for m in _KEYED}
    measured = chosen.withColumns(keyed).select(
        *kept, "__d", number(c("bpm")).alias("bpm"), number(c("bpm_confidence")).alias("__sure"), number(c("loudness")).alias("loudness"),
        _named(c("key"), KEYS).alias("key"), _named(c("scale"), SCALES).alias("mode"),
        _plain(c("strength")).alias("key_confidence"), _plain(_get(c("d"), "metadata.audio_properties.length")).alias("length"),
        number(c("spectral_centroid")).alias("centroid"), number(c("spectral_rolloff")).alias("rolloff"), number(c("dynamic_complexity")).alias("dynamic_complexity"), number(c("onset")).alias("onset_rate"),
        number(c("perceptual_tempo")).alias("perceptual_tempo"), number(c("beats_loudness")).alias("beats_loudness"), _plain(c("beats_count")).cast("int").alias("beats_count"),
        _vector(c("mfcc")).alias("__list"), number(c("mfcc")).alias("__one"), _vector(c("hpcp")).alias("hpcp"), _vector(c("spectral_contrast")).alias("spectral_contrast"),
    )
    single = F.when((F.size("__list") == 0) & F.col("__one").isNotNull(), F.array("__one")).otherwise(F.col("__list"))
    there = F.col("__d").isNotNull()
    return measured.select(
        *kept, "bpm", F.when(F.col("bpm").isNotNull(), F.coalesce("__sure", F.lit(TEMPO_CONFIDENCE))).otherwise(F.col("__sure")).alias("bpm_confidence"), "key", "mode", "key_confidence", "loudness", "centroid", "rolloff",
        "dynamic_complexity", "onset_rate", "length", F.floor(F.col("length") * 1000).cast("long").alias("duration_ms"), "perceptual_tempo", "beats_loudness", "beats_count",
        F.when(there, single).alias("mfcc"), F.when(there, F.col("hpcp")).alias("hpcp"), F.when(there, F.col("spectral_contrast")).alias("spectral_contrast"),
    )


#: What is stored of a document; the short form of older rows has five of them at most.
STORED = (
    "bpm double, bpm_confidence double, loudness double, key int, mode int, key_confidence double, duration_ms long, mfcc array<double>, hpcp array<double>, spectral_centroid double, spectral_rolloff double,"
    " spectral_contrast array<double>, dynamic_complexity double, onset_rate double, beats_count int, raw_summary variant, source_quality string, source_quality_weight double, match_confidence double"
)


def stored(measures: DataFrame) -> Column:
    """The columns of analysis_documents() as one JSON text; a summary repeats what readers of the short form look for."""
    summary = F.struct("bpm", "bpm_confidence", "perceptual_tempo", "beats_loudness", "onset_rate", "key", "mode", "loudness")
    own = ["bpm", "bpm_confidence", "loudness", "key", "mode", "key_confidence", "duration_ms", "mfcc", "hpcp", F.col("centroid").alias("spectral_centroid"), F.col("rolloff").alias("spectral_rolloff"), "spectral_contrast", "dynamic_complexity", "onset_rate", "beats_count"]
    return F.to_json(F.struct(*own, summary.alias("raw_summary")))


def restored(rows: DataFrame, column: str) -> DataFrame:
    """rows with the stored measures as columns; a text that is no object gives nulls, absent vectors are empty, weights of 0 or none count 1."""
    kept = rows.columns
    d = rows.withColumn("__d", F.try_parse_json(column)).withColumn("__d", F.when(_is(F.col("__d"), "OBJECT"), F.col("__d")))
    fields = []
    for part in STORED.split(", "):
        name, kind = part.strip().split(" ")
        value = _get(F.col("__d"), name, kind)
        if kind.startswith("array"):
            value = F.when(F.col("__d").isNotNull(), F.coalesce(value, F.array().cast(kind)))
        elif name in ("source_quality_weight", "match_confidence"):
            value = F.when(F.col("__d").isNotNull(), F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(1.0)))
        fields.append(value.alias(name))
    return d.select(*kept, *fields)
