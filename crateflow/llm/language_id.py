"""Language identification by bit-sliced Bloom filters over byte n-grams.

Learning counts the 4-byte n-grams of each language's texts. A language keeps every n-gram that makes up at least 2^-17
of its own, so it keeps 2^17 at most, whatever other languages have. One table of 2^20 words holds all languages' Bloom
filters: bit l of a word belongs to language l, so the AND of an n-gram's three words has the bits of all languages that
contain it. A text's count for a
language is the popcount of that language's slice over its n-grams; n · f of n counts are expected by false positives
alone (f: the slice's fill to the power of the number of hashes), so (count - n · f) / (1 - f) is the corrected one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.runtime import BLOCK_BYTES, KeyCounts, durable, runs, text_blocks, with_results

#: An n-gram must make up this share of a language's n-grams. Bounds each language to 1 / SHARE of them.
SHARE = 2.0**-17
SLOT_BITS = 20
#: Odd multipliers of the hash functions; the top SLOT_BITS bits of a product are a slot.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
UNKNOWN = "und"
#: Texts of fewer n-grams are too short for a share of them to tell anything.
LEAST_GRAMS = 16

_SPACED = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


@dataclass(frozen=True)
class LanguageModel:
    """languages: in bit order; table: a word of 64-bit groups per slot; fallback: the language most texts had."""

    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray
    fallback: str


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte n-grams of lower-cased texts as 32-bit numbers, and where each text's begin (one more at the end).

    All that is no letter is one space between words, and a space stands at both ends.
    """
    joined = b" " + b" \xff ".join([t.lower().encode().replace(b"\xff", b"") for t in texts]) + b" \xff"
    data = np.frombuffer(joined.translate(_SPACED), np.uint8)
    blank = data == 0x20
    data = data[~(blank & np.concatenate(([False], blank[:-1])))]
    ends = np.flatnonzero(data == 0xFF)
    wide = data.astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24) if len(wide) > 3 else np.zeros(0, np.uint32)
    whole = np.ones(len(grams), bool)
    for back in range(4):
        at = ends - back
        whole[at[(at >= 0) & (at < len(grams))]] = False
    starts = np.concatenate(([0], ends + 1))
    before = np.concatenate(([0], np.cumsum(whole)))
    return grams[whole], before[np.minimum(starts, len(grams))]


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    return [(grams * np.uint32(m)) >> np.uint32(32 - SLOT_BITS) for m in MULTIPLIERS]


def _slot_column(gram: str, multiplier: int) -> Column:
    """_slots() as a column: the product modulo 2^32 without leaving 64 bits, by halves of the n-gram."""
    low, high = F.expr(f"{gram} & 65535"), F.expr(f"shiftright({gram}, 16) & 65535")
    product = (low * F.lit(multiplier) + F.shiftleft((high * F.lit(multiplier)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(product, 32 - SLOT_BITS)


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows whose text and language are not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, KeyCounts] = {}

        def out(name: str) -> pa.RecordBatch:
            keys, n = counts[name].flush()
            return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n[:, 0])], ["lang", "gram", "n"])

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for lo, hi in text_blocks(batch, 1):
                texts = np.array(batch.column(1).slice(lo, hi - lo).to_pylist(), object)
                for name in set(names[lo:hi]):
                    keys, n = runs(_grams(list(texts[names[lo:hi] == name]))[0])
                    mine = counts.setdefault(name, KeyCounts(1))
                    mine.add(keys.astype(np.uint64), n[:, None])
                    if mine.full():
                        yield out(name)
        for name in counts:
            yield out(name)

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE) -> LanguageModel:
    """Learns from all rows with a text and a language: a language's filter holds every n-gram of that share of its own. Only the finished table of 2^SLOT_BITS words comes to the driver."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    texts = rows.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").collect()  # as many rows as languages
    languages = sorted(r["lang"] for r in texts)
    groups = max(1, -(-len(languages) // 64))
    table = np.zeros((1 << SLOT_BITS, groups), np.uint64)
    if not languages:
        return LanguageModel([], table, np.zeros(0), UNKNOWN)
    counts = count_grams(docs, text, lang)

    counts = durable(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    bit = spark_position(languages)
    kept = rates.where(F.col("rate") >= share).select("gram", F.expr(f"{bit} div 64").alias("part"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("mask"))
    slots = kept.select("part", "mask", F.explode(F.array(*[_slot_column("gram", m) for m in MULTIPLIERS])).alias("slot"))
    words = slots.groupBy("slot", "part").agg(F.bit_or("mask").alias("mask")).toPandas()  # 2^SLOT_BITS rows a group of 64 at most
    table[words["slot"].to_numpy(np.int64), words["part"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).astype(np.uint64)
    fill = np.array([np.mean((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))])
    if len(languages) <= 8:
        table = table.astype(np.uint8)
    return LanguageModel(languages, table, fill ** len(MULTIPLIERS), texts[0]["lang"])


def spark_position(languages: list[str]) -> str:
    """SQL for the bit of column lang."""
    quoted = ", ".join("'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'" for name in languages)
    return f"(array_position(array({quoted}), lang) - 1)"


def _judge(texts: list[str], model: LanguageModel) -> tuple[list[str], list[float], list[float | None]]:
    names, scores, covered = [], [], []
    grams, at = _grams(texts)
    n = np.diff(at).astype(float)
    slots = _slots(grams)
    counts = np.zeros((len(texts), len(model.languages)))
    for group in range(model.table.shape[1]):
        part = model.table[:, group]
        found = part[slots[0]] & part[slots[1]] & part[slots[2]]
        for k in range(group * 64, min(len(model.languages), group * 64 + 64)):
            hit = np.concatenate(([0], np.cumsum((found >> found.dtype.type(k % 64)) & found.dtype.type(1), dtype=np.int64)))
            counts[:, k] = hit[at[1:]] - hit[at[:-1]]
    f = model.false_positive
    counts = np.maximum(0, (counts - n[:, None] * f) / (1 - np.minimum(f, 0.999)))
    total = counts.sum(axis=1)
    for k, text in enumerate(texts):
        covered.append(None if n[k] < LEAST_GRAMS else float(counts[k].max(initial=0) / n[k]))
        if not model.languages or not has_letter(text):
            names.append(UNKNOWN)
            scores.append(0.0)
        elif total[k] == 0:
            names.append(model.fallback)
            scores.append(0.0)
        else:
            best = int(counts[k].argmax())
            names.append(model.languages[best])
            scores.append(float(counts[k, best] / total[k]))
    return names, scores, covered


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score", covered: str | None = None) -> DataFrame:
    """Adds the predicted language and its share of all languages' corrected counts (0 to 1).

    Null texts and texts without a letter are `und` with 0. A text with letters but no known n-gram gets the language
    that most texts had in learning, with 0. Ties go to the language first in alphabetical order. Texts are read whole,
    each repeated row is judged for itself, and other columns stay (columns named as the two new ones are replaced).
    covered names one more column: the corrected count over the text's own n-grams, which does not fall as languages are
    added; null for texts of fewer than LEAST_GRAMS n-grams.
    The broadcast model has 2^20 words of a byte for up to eight languages, of eight bytes for each 64 otherwise.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, covered double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, names, scores, shares, lo, size = [t or "" for t in batch], [], [], [], 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK_BYTES // 2 or k + 1 == len(texts):
                    for into, new in zip((names, scores, shares), _judge(texts[lo : k + 1], held.value), strict=True):
                        into += new
                    lo, size = k + 1, 0
            yield pd.DataFrame({"lang": names, "score": scores, "covered": pd.Series(shares, dtype=float)})

    return with_results(docs, judge(F.col(text)), {out: "lang", score: "score"} | ({covered: "covered"} if covered else {}))
