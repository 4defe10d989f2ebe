"""Queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches
from .html_extract import extract_pages
from .licenses import licenses_sql, scan_licenses
from .line_dedup import dedup_lines
from .media import text_media
from .mixing import mix_sources, mixing_sql
from .packing import pack_documents
from .pq_dedup import embedding_links
from .quality import fit_quality, held_out, score_quality
from .simhash import simhash_components
from .suffix_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def span_text(column: str):
    """Byte ranges as "start-end,start-end"."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; the CRC of each piece's ids stands for the ids."""
    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), payload="crc32")
    return out.select("doc_id", "start", "length", F.col("payload").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents by sources of weight size^0.7, one epoch, with their place in the global order."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "position")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as an image tile and reads it back."""
    arrow_batches(spark)
    return text_media(table(spark, sf_dir, "documents"), with_tiles=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines and passages; spans are byte offsets "start-end" into the original."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)
    size = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    spans = span_text("removed_spans")
    return out.select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), "removed_units", spans.alias("spans"), "text"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 400 bytes that start twice or more.

    spans are the removed byte ranges "start-end" of the original; text is what is kept, a character that a cut leaves
    incomplete reading U+FFFD (kept_sha256 is of the bytes).
    """
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", span_text("spans").alias("spans"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents with a machine fitted outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    scores = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between embeddings of a label."""
    return embedding_links(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, 4-word shingles, at most 4 differing bits."""
    return simhash_components(table(spark, sf_dir, "documents"), size=4, budget=4)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def queries():
    every = (op1_packing, op2_mixing, op3_media, op4_line_dedup, op5_suffix_dedup, op6_quality, op7_embeddings, op8_html, op9_simhash, op10_licenses)
    return {f.__name__: f for f in every}


def oracle_sql():
    return {"op2_mixing": mixing_sql(), "op10_licenses": licenses_sql()}
