"""A corpus from documents to packed sequences: each stage takes the rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm import mixing, ngram_join, packing, quality, secret_scan
from landfold.llm.common import forget, written
from landfold.llm.queries import table, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, all columns kept.

    A null or empty text is scored as an empty one and goes with its score, a null doc_id as any other; repeated rows
    have equal scores and stay or go together. No documents give none; columns named score or label do not clash.
    """
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("score >= 0.5").select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, all columns kept.

    Null and empty texts are copies of one another, other texts without words only of equal ones. Of rows that repeat
    the smallest id with the same text one stays; a null doc_id is kept only if its group has no other. No documents give none.
    """
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask.

    Null and empty texts stay as they are, repeated rows are masked alike; n_chars changes where the text does. Columns
    of any other name are kept; no documents give none.
    """
    found = secret_scan.find_secrets(docs)
    text = F.when(F.size("spans") > 0, secret_scan.masked(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves the sources by their target weights.

    A null source is the source ''; null and empty texts take the room of one character; repeated rows stand together
    in one block and all stay. All columns are kept; no documents give none.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, whose ids follow the mix: files read again come in any order, so the schedule is laid out anew.

    A null or empty text is one sequence of the end token; every row, repeated ones too, is packed by itself. Other
    columns than doc_id and text go; no documents give none.
    """
    return packing.pack_documents(mixing.mixed_documents(docs), tokenizer_path())


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", keep_one_copy), ("secret scans", mask_secrets), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written and read again."""
    docs, docs_read = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, before = written(docs, "stage"), docs_read
            docs_read = docs
            if before is not None:
                forget(before)  # the stage after it is written
    return docs


#: The classifier, the join and the schedule have no SQL form.
ORACLE_SQL = None
