"""A corpus pipeline: quality, near copies, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkspace.llm import mixing, near_dedup, packing, quality_classifier, suffix_dedup
from darkspace.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that a packing worker remembers, beside what earlier stages left in the executors.
WORDS = 150_000
#: Rows that Python workers get at a time: their number bounds an executor's memory, and no result depends on it.
#: Plans take it from the session when they run, after a stage has returned, so stages set it there.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality; it learns from the texts of ``docs`` and labels of 1.

    Null and empty texts are judged as empty ones, very long texts whole.
    Rows that share an id or a text are judged alike; rows without an id are
    judged, too. Without a positive label all stay. No rows give no rows; extra
    columns are dropped.
    """
    spark.conf.set(*BATCH)
    return quality_classifier.keep_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every group at similarity 0.8.

    Rows without an id are documents of their own and all stay. Rows that share
    an id are one document to near_duplicates, so one of them stays: the first
    by text, language, source and number of characters, nulls first. Texts
    without words (null or empty too) are like no other and stay. Very long
    texts are whole sets. Of equal texts the smallest id stays. No rows give no
    rows; extra columns are dropped.
    """
    spark.conf.set(*BATCH)
    kept = near_dedup.near_duplicates(docs.where("doc_id is not null"), percent=80).where("kept").select("doc_id")
    own = docs.select(*COLUMNS)
    again = cut(own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    named = own.where("doc_id is not null").join(kept.distinct(), "doc_id").select(*COLUMNS)
    if not again.isEmpty():
        rest = F.struct(*COLUMNS[1:])
        repeated = named.join(again, "doc_id").groupBy("doc_id").agg(F.min(rest).alias("first")).select("doc_id", "first.*")
        named = named.join(again, "doc_id", "left_anti").select(*COLUMNS).union(repeated.select(*COLUMNS))
    return named.union(own.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that an earlier document has; n_chars follows the text.

    Null texts and texts without such strings stay as they are; a text that
    loses all its bytes is empty, and a character that is cut goes. Rows
    without an id stay as they are. Very long texts are judged whole. Repeated
    ids, which the stage before leaves none of, keep one row's text. No rows
    give no rows; extra columns are dropped.
    """
    spark.conf.set(*BATCH)
    return suffix_dedup.without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them (never, once, twice).

    Texts without words take part in no target and stay once; null sources are one source. Rows that share an id
    share a hash, so they are taken alike. Very long texts are taken whole or
    not at all. No rows give no rows; extra columns are dropped.
    """
    return mixing.repeat_documents(docs.select(*COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens.

    Null and empty texts are a separator alone; documents above 4096 tokens
    give whole sequences and a rest. Repeated rows are packed as often as they
    occur; rows without an id are packed without one. No rows give no rows.
    """
    spark.conf.set(*BATCH)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memory=WORDS)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("packing", sequences),
]

#: Tokenizers, classifiers and suffix arrays have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))  # a stage reads its input more than once
    return STAGES[-1][1](spark, docs, sf_dir)
