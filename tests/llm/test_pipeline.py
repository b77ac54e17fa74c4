"""Every stage of the pipeline against brute force, each on the whole output of the one before."""

import base64
import random
import re

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from crateflow.llm import queries, secret_scan

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(path)
    return [f"{DIR}/documents.parquet", *[f"{p}/*.parquet" for p in out]]


def over(path, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    return con.sql(sql).fetchall()


def ids(path, where="true"):
    return sorted(r[0] for r in over(path, f"select doc_id from documents where {where}"))


def test_columns(spark, steps):
    first = spark.read.parquet(steps[0])
    for path in steps[1:-1]:
        assert spark.read.parquet(path.removesuffix("/*.parquet")).columns == first.columns


def test_language_keeps_what_has_a_language(spark, steps):
    assert ids(steps[1]) == ids(steps[0])
    rows = [(1, "12 34 !!", None, "a", 8), (2, None, "en", "a", 0), (3, "the house of the king", "en", "a", 21), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in C.identify_language(spark, docs, DIR).collect()] == [3]


@pytest.mark.parametrize("n", [2, 30])
def test_what_stays_does_not_depend_on_the_number_of_languages(spark, n):
    rnd = random.Random(n)
    common = ["".join(rnd.choice("aeiourstlnm") for _ in range(5)) for _ in range(40)]  # words that all languages share
    own = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)] for _ in range(n)]
    made = [(f"l{k:02}", " ".join(rnd.choice(own[k] if rnd.random() < 0.6 else common) for _ in range(80))) for k in range(n) for _ in range(8)]
    rows = [(k, text, lang) for k, (lang, text) in enumerate(made)] + [(900, "ж" * 4 + " щюя" * 40, None), (901, "hi", None), (902, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in C.identify_language(spark, docs, DIR).collect()) == [*range(len(made)), 901]


def test_near_copies(steps):
    assert ids(steps[2]) == sorted(r[0] for r in over(steps[1], f"select doc_id from ({queries.JACCARD_SQL}) where kept"))


def test_secrets(steps):
    texts = dict(over(steps[3], "select doc_id, text from documents"))
    hidden = 0
    for doc_id, text in over(steps[2], "select doc_id, text from documents"):
        assert (len(texts[doc_id]),) == over(steps[3], f"select n_chars from documents where doc_id = {doc_id}")[0]
        found = [m for r in secret_scan.BASE_RULES + secret_scan.MORE_RULES for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
        hidden += bool(found)
        assert texts[doc_id] == text if not found else all(m[0] not in texts[doc_id] for m in found)
    assert hidden


def test_mixing(steps):
    sql = queries.mix_sql(C.MIX_SHARE, C.MIX_EPOCHS, C.MIX_SEED)
    assert ids(steps[4]) == sorted(r[0] for r in over(steps[3], f"select doc_id from ({sql}) where n_copies > 0"))


def test_token_ids(spark, steps):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(over(steps[4], "select doc_id, text from documents"))
    rows = over(steps[5], "select doc_id, n_tokens, token_ids from documents")
    assert sorted(r[0] for r in rows) == ids(steps[4])
    for doc_id, n, data in rows:
        want = oracle.encode_ordinary(texts[doc_id])
        assert n == len(want) and list(memoryview(bytes(data)).cast("I")) == want


def test_run(spark, steps):
    assert sorted(r.doc_id for r in C.run(spark, DIR).select("doc_id").collect()) == ids(steps[5])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0 and F


CLASHES = ["__lang", "__score", "__covered", "domain", "n_tokens", "leaf_tokens", "leaf_budget", "n_copies", "row", "id", "mark", "found", "score", "kinds", "__id", "__hash", "a.b", "a b`c"]


def test_other_columns_stay_whatever_their_names(spark):
    """Names that operators use inside, dots and quotes; repeated rows, ties, a very long text, nulls in every column."""
    long = "the house of the king and the river near the wood " * 8_000
    texts = [long, "the house of the king is near the river in the wood and all is well today", "password = hunter2hunter2 and the house of the king near the river in the wood"]
    rows = [(k, t, "en", f"s{k % 2}", len(t)) for k, t in enumerate(texts)]
    rows += [rows[1], rows[2], (1, "another text of the same id that tells of a long road to the sea", "en", "s1", 1), (None, "a text without an id about the sea and a road and a boat", None, None, None), (9, None, None, None, None)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.select("*", *[F.lit(f"mine {k}").alias(c) for k, c in enumerate(CLASHES)])
    for name, stage in C.STAGES[:-1]:
        plain = [tuple(r) for r in stage(spark, base, DIR).select("doc_id", "text", "lang", "source", "n_chars").collect()]
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(list(r)[5:] == [f"mine {k}" for k in range(len(CLASHES))] for r in got), name
        assert sorted(map(repr, plain)) == sorted(repr(tuple(r)[:5]) for r in got) and got, name
    assert C.encode_tokens(spark, docs, DIR).columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]


def test_stages_on_repeated_rows_ties_and_long_texts(spark):
    """Each row is masked by its own text, drawn with its repetitions, and encoded for itself."""
    secret = "token: abcdef123456 " + "word " * 40_000
    rows = [(1, secret, "en", "s0", 0), (1, secret, "en", "s0", 0), (2, secret, "en", "s0", 0), (1, "plain text", "en", "s0", 0), (3, "", "en", "s0", 0), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    masked = C.mask_secrets(spark, docs, DIR).collect()
    assert len(masked) == 6 and sum("abcdef123456" in (r.text or "") for r in masked) == 0
    assert sorted((r.doc_id, r.n_chars or -1) for r in masked) == sorted((i, -1 if t is None else len(t.replace("token: abcdef123456", "[secret]")) or -1) for i, t, *_ in rows)
    mixed = [(r.doc_id, len(r.text)) for r in C.mix_sources(spark, docs, DIR).collect()]
    assert mixed.count((1, len(secret))) in (0, 2) and all(n for _, n in mixed)
    coded = C.encode_tokens(spark, docs, DIR).collect()
    assert len(coded) == 6 and len({bytes(r.token_ids) for r in coded if r.n_tokens > 100}) == 1 and sorted(r.n_tokens for r in coded)[:2] == [0, 0]
