import base64
import struct
import weakref

import public_tokenizers as P
import pytest
import tiktoken

from crateflow.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", None, "a", " ", "   leading and  trailing   ", "It's we'll they've I'm 'd 're", "naïve café Ünïcødé ʯ", "日本語 текст ١٢٣ ²½ Ⅷ",
    "tab\tnew\nline\r\n\x1c\x85\xa0 x", "a" * 5000, " " * 3000 + "x", "aAbB" * 700, "<|endoftext|>", "!!!???### $$$", "zzzqqqxxxjjj" * 40, "🎵🎶 emoji ’ quotes “x”", "1234567890" * 30,
]


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_reference_tokenizer(spark, oracle):
    words = byte_bpe.vocabulary(spark, PATH, P.PATTERN)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "", "again")], "doc_id long, text string, token_ids string")
    rows = byte_bpe.decode(byte_bpe.encode(df, words), words).collect()
    assert byte_bpe.round_trip(df, words).collect() == rows
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = oracle.encode_ordinary(r.text or "")
        assert list(struct.unpack(f"<{len(r.token_ids) // 4}I", bytes(r.token_ids))) == want
        assert bytes(r.decoded) == (r.text or "").encode()


def test_whole_table_against_the_reference_tokenizer(spark, oracle):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = byte_bpe.vocabulary(spark, PATH, P.PATTERN)
    for r in byte_bpe.encode(df, words).collect():
        assert bytes(r.token_ids) == b"".join(struct.pack("<I", k) for k in oracle.encode_ordinary(r.text))


def test_default_pattern_is_the_given_one():
    assert byte_bpe.DEFAULT_PATTERN == P.PATTERN


def test_pieces_of_any_bytes(oracle):
    import random

    codec, rnd = byte_bpe.Codec(byte_bpe.read_ranks(PATH), P.PATTERN), random.Random(7)
    for _ in range(3000):
        text = "".join(rnd.choice("abcdefghiertnsoé ñ-") for _ in range(rnd.randint(1, 40)))
        assert list(memoryview(codec.encode(text)).cast("I")) == oracle.encode_ordinary(text)


def test_empty_table(spark):
    words = byte_bpe.vocabulary(spark, PATH)
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), words).count() == 0


def test_a_worker_holds_one_codec(spark):
    first = byte_bpe._codec(byte_bpe.vocabulary(spark, PATH, P.PATTERN))
    assert byte_bpe._codec(byte_bpe.vocabulary(spark, PATH, P.PATTERN)) is first
    gone = weakref.ref(first)
    del first
    other = byte_bpe._codec(byte_bpe.vocabulary(spark, PATH, r"\S+|\s+"))
    assert gone() is None and other.pattern.pattern == r"\S+|\s+"
