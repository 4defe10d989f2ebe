"""Retrieval quality: hit rates, reciprocal rank, lift between runs, tuning and benchmark grids, and query samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, strip

CHUNK_SIZES = (30, 45, 60, 90, 120)
DEFAULT_SIZE = 60
# Definitions worth asking for, by the first pattern that matches a line.
DEFINITIONS = [
    (r"^\s*def\s+(\w+)\s*\(", "function"), (r"^\s*class\s+(\w+)", "class"), (r"^\s*async\s+def\s+(\w+)", "async function"),
    (r"^\s*function\s+(\w+)\s*\(", "function"), (r"^\s*(?:export\s+)?class\s+(\w+)", "class"), (r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", "function"),
    (r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*\{", "object"), (r"^\s*func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", "function"), (r"^\s*type\s+(\w+)\s+struct", "struct"),
    (r"^\s*type\s+(\w+)\s+interface", "interface"), (r"^\s*(?:pub\s+)?fn\s+(\w+)", "function"), (r"^\s*(?:pub\s+)?struct\s+(\w+)", "struct"),
    (r"^\s*(?:pub\s+)?trait\s+(\w+)", "trait"), (r"^\s*impl\s+(?:\w+\s+for\s+)?(\w+)", "implementation"),
    (r"^\s*(?:public|private|protected)?\s*class\s+(\w+)", "class"), (r"^\s*(?:public|private|protected)?\s*interface\s+(\w+)", "interface"),
    (r"^\s*def\s+(\w+)", "method"), (r"^\s*class\s+(\w+)", "class"), (r"^\s*module\s+(\w+)", "module"),
]
#: Indexes of the shorter list that the benchmark samples from.
BENCHMARK_DEFINITIONS = [DEFINITIONS[i] for i in (0, 1, 2, 3, 4, 5, 7, 8, 10, 11, 14, 16, 17)]


def significant_lines(files: DataFrame, path: str = "path", text: str = "text", most: int | None = None, seed: int = 0, patterns=None) -> DataFrame:
    """(path, line_number, line, query): definitions in the files; at most `most` of them, drawn by a seeded hash.

    A name that starts with "__" or "test_" is passed over, and the next pattern is tried.
    """
    own = files.select(path, F.posexplode(lines(F.col(text))).alias("i", "line"))
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, what in reversed(patterns or DEFINITIONS):
        got = F.regexp_extract("line", pattern, 1)
        good = (got != "") & ~F.startswith(got, F.lit("__")) & ~F.startswith(got, F.lit("test_"))
        name, kind = F.when(good, got).otherwise(name), F.when(good, F.lit(what)).otherwise(kind)
    query = F.concat(F.lit("where is the "), F.col("kind"), F.lit(" "), F.col("name"), F.lit(" defined"))
    found = own.select(path, (F.col("i") + 1).cast("long").alias("line_number"), strip(F.col("line")).alias("line"), name.alias("name"), kind.alias("kind"))
    found = found.where("name is not null").select(path, "line_number", "line", query.alias("query"))
    if most is None:
        return found
    return found.orderBy(F.xxhash64(F.lit(seed), path, "line_number"), path, "line_number").limit(most)


def first_ranks(results: DataFrame, truth: DataFrame, query: str = "query_id", expected: str = "expected", path: str = "path", rank: str = "rank") -> DataFrame:
    """(query, rank): the first result whose path ends with or contains what is expected; null if none."""
    found = results.join(truth, query).where(F.endswith(path, F.col(expected)) | F.contains(path, F.col(expected)))
    best = found.groupBy(query).agg(F.min(rank).alias("rank"))
    return truth.select(query).join(best, query, "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """(n, hit_at_1, hit_at_3, hit_at_5, mrr): counts of hits and the mean reciprocal rank, a missing rank being 0."""
    hit = [F.count_if(F.col("rank") <= k).alias(f"hit_at_{k}") for k in (1, 3, 5)]
    return ranks.agg(F.count("*").alias("n"), *hit, F.avg(F.coalesce(F.lit(1.0).cast("double") / F.col("rank"), F.lit(0.0))).alias("mrr"))


def lift(base: DataFrame, other: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, base_rank, new_rank, lift, outcome): what a second run did to each query's rank."""
    both = base.select(query, F.col("rank").alias("base_rank")).join(other.select(query, F.col("rank").alias("new_rank")), query, "full")
    b, n = F.col("base_rank"), F.col("new_rank")
    outcome = (
        F.when(b.isNull() & n.isNull(), "none").when(b.isNull(), "NEW").when(n.isNull(), "LOST").when(n < b, "improved").when(n == b, "unchanged").otherwise("degraded")
    )
    return both.select(query, "base_rank", "new_rank", (b - n).alias("lift"), outcome.alias("outcome"))


def lift_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("outcome").isin("improved", "NEW")).alias("improved"),
        F.count_if(F.col("outcome").isin("unchanged", "none")).alias("unchanged"),
        F.count_if(F.col("outcome").isin("degraded", "LOST")).alias("degraded"),
        F.coalesce(F.sum("lift"), F.lit(0)).alias("total_lift"),
    )


def covering_ranks(results: DataFrame, samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample, rank): first result of the sample's file whose lines hold the sample's line."""
    best = results.join(samples, [sample, "path"]).where(F.col("line_number").between(F.col("start_line"), F.col("end_line"))).groupBy(sample).agg(F.min("rank").alias("rank"))
    return samples.select(sample).join(best, sample, "left")


def weighted_accuracy(ranks: DataFrame, *by: str) -> DataFrame:
    """(*by, accuracy, hits): 1 for a first place down to 0.2 for a fifth, 0 beyond; mean over the samples."""
    points = F.when(F.col("rank") <= 5, (6 - F.col("rank")) / 5.0).otherwise(0.0)
    return ranks.groupBy(*by).agg(F.avg(F.coalesce(points, F.lit(0.0))).alias("accuracy"), F.count_if(F.col("rank") <= 5).alias("hits"))


def best_setting(results: DataFrame, score: str = "accuracy", order: str = "chunk_lines") -> DataFrame:
    """The row of the best score; of equals the first by `order`."""
    return results.orderBy(F.desc(score), order).limit(1)


def best_by_model(results: DataFrame) -> DataFrame:
    """(model, chunk_lines, overlap, accuracy, hits, mean_seconds): the best setting of each model."""
    pick = F.max_by(F.struct("chunk_lines", "overlap", "accuracy", "hits"), F.struct(F.col("accuracy"), -F.col("chunk_lines"), -F.col("overlap")))
    return results.groupBy("model").agg(pick.alias("b"), F.avg("seconds").alias("mean_seconds")).select("model", "b.*", "mean_seconds").orderBy(F.desc("accuracy"), "model")


def grid(spark, models: list[str], sizes=CHUNK_SIZES, overlaps=(5, 10, 15, 20)) -> DataFrame:
    """All settings in which the overlap is smaller than the chunk."""
    rows = [(m, s, o) for m in models for s in sizes for o in overlaps if o < s]
    return spark.createDataFrame(rows, "model string, chunk_lines int, overlap int")
