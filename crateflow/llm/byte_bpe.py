"""Byte-level BPE encoding and decoding, exact merges in time linear in the text.

The vocabulary's byte strings go into an Aho-Corasick automaton as Latin-1 text. For each piece of the pre-tokenising
pattern one pass of the automaton gives the longest token that starts at every byte. Encoding takes these tokens from
left to right; a token is accepted if it is compatible with its left neighbour, that is, if merging in rank order
would leave the border between the two alone. An incompatible token is replaced by its next shorter prefix token, and
when there is none, the neighbour is taken back. A byte position from which no continuation was found is not tried
again, which keeps the search linear. Compatibility of two adjacent tokens is memoised.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.llm.runtime import with_results

#: Pieces and pairs that a worker memoises; beyond that the memory is emptied and refilled.
MEMO_PIECES, MEMO_PAIRS = 1 << 16, 1 << 18

#: Letters for which Python's own re module agrees with \p{L}; other non-ASCII characters send a text to the full pattern.
_PLAIN = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_ODD = re.compile(rf"[^\x00-\x7f{_PLAIN}]")
_FAST = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_PLAIN}]+| ?[0-9]+| ?[^\t-\r {_PLAIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def read_ranks(path: str) -> list[bytes]:
    """The token bytes in rank order, from a file of base64 token and rank per line."""
    with open(path, "rb") as file:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file)]
    tokens = [token for _, token in sorted(pairs)]
    if [rank for rank, _ in sorted(pairs)] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return tokens


class Codec:
    """Encodes and decodes by a vocabulary; plain Python, one per worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import ahocorasick
        import regex

        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.fast = _FAST if pattern == DEFAULT_PATTERN else None
        self.rank = {token: k for k, token in enumerate(tokens)}
        self.size = [len(token) for token in tokens]
        self.automaton = ahocorasick.Automaton()
        for k, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.compatible: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        if (found := self.shorter.get(token)) is None:
            word = self.tokens[token]
            found = self.shorter[token] = next((self.rank[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in self.rank), -1)
        return found

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one (None: a single byte), by merging its bytes in rank order."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], len(self.rank)))
                if parts[best] + parts[best + 1] not in self.rank:
                    raise ValueError(f"no merges make token {token}")
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the border between two adjacent tokens outlives all merges.

        Undoes the merges on both sides of the border, the latest first. Were the pair that then faces the border the
        halves of a token that ranks before every merge undone so far, that merge would have crossed the border.
        """
        key = left << 32 | right
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) >= MEMO_PAIRS:
                self.compatible.clear()
            known, bound = True, len(self.tokens)
            while True:
                crossing = self.rank.get(self.tokens[left] + self.tokens[right], bound)
                if crossing < bound and self.split(crossing) == (left, right):
                    known = False
                    break
                a, b = self.split(left), self.split(right)
                if a is None and b is None:
                    break
                # the later merge is undone; of two equal ranks the right one is the later, as merges go from the left
                if b is None or (a is not None and left > right):
                    bound, left = left, a[1]
                else:
                    bound, right = right + 1, b[0]
            self.compatible[key] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        longest = [0] * len(data)
        size, fits = self.size, self.fits
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends come in rising order, so the longest stays
        open_ = bytearray(b"\x01") * (len(data) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(data):
            end = at + size[token]
            if open_[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(data) else 0
            elif (shorter := self.prefix(token)) >= 0:
                token = shorter
            else:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo, pieces = self.memo, (self.fast or self.pattern).findall(text) if self.fast and not _ODD.search(text) else self.pattern.findall(text)
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            out = []
            for p in pieces:
                if (ids := memo.get(p)) is None:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    ids = b"".join(k.to_bytes(4, "little") for k in self.piece(p.encode()))
                    if len(p) <= 64:
                        memo[p] = ids
                out.append(ids)
            return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


#: The pattern for which the quick form above is exact: the usual one of byte-level BPE.
DEFAULT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_held: Codec | None = None


def _codec(vocabulary: Broadcast) -> Codec:
    """The worker's one codec: kept for every broadcast of the same vocabulary, gone before that of another is made."""
    global _held
    tokens, pattern = vocabulary.value
    if _held is None or _held.pattern.pattern != pattern or _held.tokens != tokens:
        _held = None
        _held = Codec(tokens, pattern)
    return _held


def vocabulary(spark: SparkSession, path: str, pattern: str = DEFAULT_PATTERN) -> Broadcast:
    """The vocabulary for encode() and decode(): read once on the driver; its size is that of the rank file, whatever the data."""
    return spark.sparkContext.broadcast((read_ranks(path), pattern))


def encode(docs: DataFrame, words: Broadcast, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds the column `out` (binary): the token ids of `text`, little-endian unsigned 32-bit.

    A null text counts as empty and has no ids; there are no special tokens, their strings are ordinary text. Texts
    of any length are encoded whole. Every row keeps its other columns; a column named as `out` is replaced. Repeated
    rows and ties are encoded each for itself, and an empty table gives an empty table.
    """

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(words)
        for batch in texts:
            yield pd.Series([codec.encode(t or "") for t in batch], dtype=object)

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, words: Broadcast, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the column `out` (binary): the bytes that the ids in `ids` stand for. Null ids give no bytes."""

    @F.pandas_udf("binary")
    def raw(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(words)
        for batch in column:
            yield pd.Series([codec.decode(x or b"") for x in batch], dtype=object)

    return docs.withColumn(out, raw(F.col(ids)))


def round_trip(docs: DataFrame, words: Broadcast, text: str = "text", ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """encode() and decode() of its ids in one pass over the texts, for checking that nothing is lost."""

    @F.pandas_udf("ids binary, raw binary")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(words)
        for batch in texts:
            coded = [codec.encode(t or "") for t in batch]
            yield pd.DataFrame({"ids": coded, "raw": [codec.decode(x) for x in coded]}, dtype=object)

    return with_results(docs, both(F.col(text)), {ids: "ids", out: "raw"})
