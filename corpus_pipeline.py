"""From raw documents to packed sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import langid, minhash, packing, pii, suffixes
from evalloom.llm.common import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Code length in bits a byte from which a text counts as no known language.
MOST_BITS = 6.5


# Every stage takes tables with nulls in any column, empty and very long texts, repeated rows and no rows at all; it
# returns the columns of documents alone, whatever other columns there are.
def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose text is like a learned language.

    Null texts and those without letters go; if no document has a language, nothing is learned and all go."""
    model = langid.fit(docs)
    found = langid.identify(docs, model)
    return found.where((F.col("langid.lang") != "und") & (F.col("langid.bits_per_byte") <= MOST_BITS)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group. Texts without words are alone in theirs and stay, as do null ones; of repeated rows one stays."""
    return minhash.near_duplicates(docs).where("chosen").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 200 bytes and more that occur elsewhere out of the texts. Null texts stay null; a text that repeats another one whole becomes empty."""
    return counted(suffixes.remove_repeats(docs, in_place=True))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds. Null texts stay null."""
    return counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences. A null or empty text is the end id alone; repeated rows are packed each."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each one before it returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
