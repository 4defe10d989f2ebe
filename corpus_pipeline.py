"""From raw documents to packed training sequences: five stages, each on all its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Defined results: null texts count as empty; a row without an id is kept by the near-duplicate stage and cannot be held out;
of rows that repeat an id and a text one is kept; extra columns, whatever their names, go along with their rows; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm.catalog import tokenizer_file
from lakeseek.llm.common import Scratch
from lakeseek.llm.line_dedup import dedup_lines
from lakeseek.llm.mixing import mix_sources
from lakeseek.llm.packing import pack_documents
from lakeseek.llm.quality import fit_quality, keep_quality
from lakeseek.llm.simhash import drop_near_duplicates


def _beside(docs: DataFrame, *used: str) -> DataFrame:
    """The other columns under names that no operator uses, in the same order."""
    return docs.toDF(*(c if c in used else f"__beside_{c}" for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a shingle similarity (five words) of 0.8 or more."""
    return drop_near_duplicates(docs, similarity=0.8, size=5)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and passages that an earlier document has; n_chars follows the text."""
    own = _beside(docs, "doc_id", "text")
    kept = dedup_lines(own).select(*own.columns).toDF(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that a source's share is as its size to the power 0.7, in a global random order."""
    own = _beside(docs, "doc_id", "text", "source")
    return mix_sources(own).select(*own.columns).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all copies, in sequences of at most 2048 tokens."""
    out = pack_documents(docs, tokenizer_file(), payload="crc32")
    return out.select("doc_id", "start", "length", F.col("payload").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]

#: No SQL: the classifier is trained and near-duplicate classes are components of links; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves is written to the shared folder and read by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.save(out, name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
