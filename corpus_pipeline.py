"""A corpus pipeline of five stages over documents, each an operator of rasterspark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents, whatever other
columns docs has, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm import decontaminate, langid, packing, simhash, substring_dedup
from rasterspark.llm.common import scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is named with confidence; learned from their own labels.

    Null texts and texts without a letter are rejected; rows with a null lang are judged, not learned from. Rows are judged
    each, repeated ones and null ids too; a long text is read whole.
    """
    model = langid.fit(docs)
    return langid.identify(docs, model).filter(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates.

    Null, empty and blank texts are equal to each other, so one of them stays. Of a group the smallest doc_id stays, of
    rows that share it one; a long text is compared by all its shingles.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat an earlier passage; n_chars follows the text.

    No document goes: null and blank texts stay as they are, and one that is a repeat throughout keeps an empty text. Rows
    of one doc_id are judged together, those without an id keep everything; long texts are read by blocks.
    """
    cleaned = substring_dedup.remove(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay. Rows are judged each, repeated ones and null ids too.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences.

    A null or empty text is its end token alone. Rows are packed each; a long text is many pieces.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substrings", substrings),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

#: SQL cannot express the stages (a trained model, fingerprints, a tokenizer); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
