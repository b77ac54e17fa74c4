"""A pipeline over `documents`: language ID, near-copies, secrets, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of their input. Near-copies and mixing have random parts, and token ids no SQL, so ORACLE_SQL is None; the tests hold every
stage against brute force. An empty table goes through all stages, texts are read whole whatever their length, and columns
beyond those of documents stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateflow.llm import byte_bpe, jaccard_join, language_id, secret_scan, source_mix
from crateflow.llm.queries import MIX_LEVELS, domain_of
from crateflow.llm.runtime import durable, small_batches

#: Documents whose best language has less of their own n-grams than this are rejected, as those without a letter.
LEAST_COVERED = 0.3
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 1, 29


#: What the stages read. All other columns travel in one struct, where no operator's names can meet theirs.
READ = ("doc_id", "text", "lang", "source")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, as far as docs has them, and row: a struct of its other columns."""
    others = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns if c not in READ]
    return docs.select(*[c for c in READ if c in docs.columns], (F.struct(*others) if others else F.lit(0)).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs, in their order, from rows of packed(); new ones by name."""
    return rows.select(*[(new[c] if c in new else F.col(c) if c in READ else F.col("row").getField(c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows with a text and a language; drops documents of no language. Texts too short to judge stay.

    Null and empty texts and those without a letter go, each repeated row is judged for itself, and ties between languages
    don't matter here. A row without a language is judged and not learned from; null ids are nothing special.
    """
    small_batches(spark)
    rows = packed(docs)
    judged = language_id.predict(rows, language_id.learn(rows), out="found", score="score", covered="covered")
    return unpacked(judged.where((F.col("found") != language_id.UNKNOWN) & F.coalesce(F.col("covered") >= LEAST_COVERED, F.lit(True))), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-copies; null ids are the largest.

    One row of a class stays even where rows are repeated or share an id. Null, empty and blank texts are no copies: all stay.
    """
    small_batches(spark)
    return unpacked(jaccard_join.keep_one_row(packed(docs)), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks what the rules find and counts the characters anew; null texts stay null, and so does their count.

    No row goes; repeated rows and rows of one id are masked alike or each by its own text.
    """
    return unpacked(secret_scan.redact(packed(docs)), docs, n_chars=F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the documents of MIX_SHARE of the tokens by the target weights, each once at most.

    Null and empty texts are never drawn, null languages and sources are leaves of their own, repeated rows have one place
    in the order and are drawn together.
    """
    mixed = source_mix.mix(packed(docs).withColumn("domain", domain_of()), MIX_LEVELS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return unpacked(mixed.where("n_copies > 0"), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (little-endian unsigned 32-bit), a row per row; a null text has no ids."""
    import public_tokenizers

    small_batches(spark)
    words = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = byte_bpe.encode(docs.select(*READ), words)
    return coded.select("doc_id", "lang", "source", F.expr("length(token_ids) div 4").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each kept is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
