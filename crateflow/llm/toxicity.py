"""Toxicity by compression distance: windows of text against a toxic and an ordinary zstandard dictionary.

Both dictionaries begin with the same content, trained on ordinary text, so that ordinary prose compresses alike with
either. The toxic one goes on with content trained on the toxic texts' distinctive words: those in a good share of the
toxic sample and several times rarer in the ordinary one (common words would fill a dictionary of this size otherwise).
A window's distance is its compressed length by the ordinary dictionary less that by the toxic one. A text's mean, its
largest, its three largest and its share of large distances go into a logistic curve, fitted on labelled texts that the
dictionaries have not seen; its value is the score, and 0.5 the threshold it is calibrated to.

The fit uses a bounded sample, up to SAMPLE documents of each label in the order of a hash of the id, none over
SAMPLE_CHARS characters;
every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CHARS = {1: 4000, 0: 8000}, 20_000
WINDOW, BASE_BYTES, TOXIC_BYTES, LEVEL = 64, 1 << 15, 1 << 10, 3
#: A distinctive word is in this share of the toxic texts (and in three at least), and this much rarer elsewhere.
WORD_SHARE, WORD_LIFT = 0.03, 8.0
LARGE = 4
#: Windows that a dictionary is trained on.
TRAINED = 1 << 15

_WORD = re.compile(rb"[^\x00-\x40\[-`{-\x7f]+")
_WINDOW = re.compile(rb"\S.{0,%d}(?!\S)|\S{1,%d}" % (WINDOW - 1, WINDOW), re.S)


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    scale: tuple[float, ...]


def windows(text: str) -> list[bytes]:
    """Lower-cased runs of up to WINDOW bytes that end where a word does (a longer word is cut)."""
    return _WINDOW.findall(text.lower().encode())


class Scorer:
    def __init__(self, model: ToxicityModel):
        import zstandard

        def compressor(content: bytes):
            if len(content) < 8:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.ordinary, self.toxic = compressor(model.ordinary).compress, compressor(model.toxic).compress
        self.weights, self.scale = np.array(model.weights), np.array(model.scale)

    def features(self, text: str) -> list[float]:
        a, b = self.ordinary, self.toxic
        found = [len(a(w)) - len(b(w)) for w in windows(text)]
        if not found:
            return [0.0, 0.0, 0.0, 0.0]
        top = sorted(found)[-3:]
        return [sum(found) / len(found), float(top[-1]), sum(top) / len(top), sum(1 for x in found if x >= LARGE) / len(found)]

    def score(self, text: str) -> float:
        x = np.append(np.array(self.features(text)) / self.scale, 1.0)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.lower().encode())


def distinctive(toxic: Sequence[str], ordinary: Sequence[str]) -> set[bytes]:
    mine, other = (Counter(w for t in texts for w in set(words(t))) for texts in (toxic, ordinary))
    least = max(3, WORD_SHARE * len(toxic))
    return {w for w, n in mine.items() if n >= least and n / len(toxic) >= WORD_LIFT * (other[w] + 0.5) / (len(ordinary) + 1)}


def drawn_windows(texts: Sequence[str], most: int = TRAINED) -> list[bytes]:
    """Windows from everywhere in all texts: all of them, or about `most`, drawn by their hash."""
    found = [w for t in texts for w in windows(t)]
    return found if len(found) <= most else [w for w in found if crc32(w) < (most << 32) // len(found)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary's content of about this size; of few samples, which training refuses, simply their end."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()[-(size * 3 // 4) :]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def fit(toxic: Sequence[str], ordinary: Sequence[str], toxic_check: Sequence[str], ordinary_check: Sequence[str]) -> ToxicityModel:
    """From the texts for the dictionaries and those for the curve."""
    base = _trained(BASE_BYTES, drawn_windows(ordinary)) if ordinary else b""
    telling = distinctive(toxic, ordinary)
    told = [b" " + b" ".join(w for w in words(t) if w in telling) for t in toxic] if telling else [b" ".join(drawn_windows(toxic))]
    pieces = [t[k : k + WINDOW] for t in told for k in range(0, len(t), WINDOW)]
    special = _trained(TOXIC_BYTES, pieces * max(1, 20_000 // max(1, len(pieces)))) if pieces else b""
    model = ToxicityModel(base, base + special, (0.0,) * 5, (1.0,) * 4)
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for t in [*toxic_check, *ordinary_check]]).reshape(-1, 4)
    y = np.concatenate([np.ones(len(toxic_check)), np.zeros(len(ordinary_check))])
    scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(4)
    x = np.column_stack([x / scale, np.ones(len(x))])
    return ToxicityModel(base, base + special, tuple(_logistic(x, y).tolist()), tuple(scale.tolist()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton's method; the last column is the constant, the others are held back a little."""
    w, hold = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id") -> ToxicityModel:
    """Fits on a bounded sample of the documents whose label is 0 or 1 and whose text is not null.

    labels has doc_id and the label. The sample's ids are drawn from the labels alone, so texts that are not in it
    never move. A quarter of it (by hash) calibrates. Without labels of both kinds the score is a constant.
    """
    order = F.xxhash64("__i")
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__i"), F.col(label).cast("int").alias("__l"))
    drawn = [known.where(F.col("__l") == k).orderBy(order, "__i").limit(n) for k, n in SAMPLE.items()]
    fits = docs.where(F.length(text) <= SAMPLE_CHARS).select(F.col(doc_id).alias("__d"), F.col(text).alias("__t"))
    rows = fits.join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("__d") == F.col("__i"))  # SAMPLE ids at most
    parts: dict[int, list[tuple[int, str]]] = {k: [] for k in SAMPLE}
    for r in rows.select("__l", order.alias("h"), "__t").collect():
        parts[r["__l"]].append((r["h"], r["__t"]))
    texts = {(k, c): [t for h, t in sorted(parts[k]) if (h % 4 == 0) == c] for k in parts for c in (True, False)}
    if not all(texts.values()):
        return ToxicityModel(b"", b"", (0.0,) * 4 + (_log_odds(len(parts[1]), len(parts[0])),), (1.0,) * 4)
    return fit(texts[1, False], texts[0, False], texts[1, True], texts[0, True])


def _log_odds(toxic: int, ordinary: int) -> float:
    return float(np.log((toxic + 0.5) / (ordinary + 0.5))) if toxic + ordinary else -1.0


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds the score (0 to 1, higher: toxic likelier) and predicted (1 from 0.5).

    Null and empty texts have no window and get the curve's value at no distance. Other columns stay, columns named as
    the new ones are replaced, repeated rows are scored alike, an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of some 32 KB

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value)
        for batch in batches:
            yield pd.Series([scorer.score(t or "") for t in batch], dtype=float)

    return docs.withColumn(out, scores(F.col(text))).withColumn(predicted, F.when(F.col(out) >= 0.5, 1).otherwise(0))
