"""The corpus pipeline: stages that each apply one operator to what the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm.common import hold, read, short_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A text whose most likely language has less than this mean probability is in none of them.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language by a conditional random field; texts without a recognised language go.

    Null and empty texts and texts without a letter go; a null ``lang`` teaches nothing; without any
    labelled text nothing is recognised. Repeated rows are judged alike, ties go to the first label.
    Texts of any length are judged whole. Other columns stay, whatever their names.
    """
    from clusterloom.llm import crf_language

    short_batches(spark)
    return crf_language.accept(docs, crf_language.train(docs, F.col("lang").isNotNull()), MIN_LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of similar documents the one of the smallest id stays.

    Null and empty texts are copies of nothing (of repeated rows one stays); texts under five words
    are compared whole; a null id stays only in a group without another. Other columns stay.
    """
    from clusterloom.llm import ngram_join

    short_batches(spark)
    return ngram_join.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix sorting: bytes of long repeated strings go; half characters at the cuts go with them.

    Null, empty and short texts stay as they are; copies and repeated rows lose all of a long text,
    which is then empty; ``n_chars`` follows a cut text, other columns stay, whatever their names.
    """
    from clusterloom.llm import column_suffixes

    short_batches(spark)
    return column_suffixes.remove_text(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Template canonicalisation: documents that hold a benchmark item go.

    Null and empty texts hold none; an empty benchmark drops nothing; repeated rows share a verdict;
    how well an item is covered does not matter beyond the threshold, so there are no ties. Texts of
    any length are searched whole. Other columns stay, whatever their names.
    """
    from clusterloom.llm import template_decontamination

    short_batches(spark)
    return template_decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text that is left, with the digest of their decoded bytes.

    A null text encodes as the empty one, to no ids; repeated rows are encoded one by one; texts of
    any length are encoded whole. Columns besides ``doc_id`` and ``text`` are not returned.
    """
    import public_tokenizers

    from clusterloom.llm import byte_bpe

    short_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # Held between the two, so that no task keeps the workers of both.
    ids = hold(byte_bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN))
    encoded = byte_bpe.decode(ids, path)
    return encoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", remove_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode_tokens),
]

#: The stages learn models and hash text by rules that SQL lacks; tests hold them to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read back by the next one."""
    from clusterloom.llm.common import stage_folder

    folder = stage_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
