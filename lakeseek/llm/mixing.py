"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: the share of the token budget it is to have over its size. A document's number of
copies inverts the Poisson distribution of that mean at a uniform number hashed from its id, so it depends on nothing but
the id, the seed and the rate. Copies are exploded and put in one global random order by a second hash.

Rates above `part` are split into equal parts whose counts add up, which is the same distribution and keeps exp(-rate)
well above zero. Sizes are characters of text.

Defined results: null texts have size 0 and, like all rows of a source without characters, rate 0; null sources are one
source; rows that repeat an id have the same count; null ids count as the id "null"; an empty table gives no rows; extra
columns stay unless named like a column of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OWN = ("copy", "position")
#: Sources up to which the table of rates is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, size, rate): mean copies of a document of the source, rounded to nine digits.

    targets: weights by source (others get none); without them a source's weight is its size to the power alpha. The
    budget is `epochs` times the size of all documents.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if targets is None:
        weight = F.pow("size", F.lit(float(alpha)))
    else:
        pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    total = sizes.agg(F.sum("size"), F.sum("weight")).collect()[0]
    if not total[0] or not total[1]:
        return sizes.select("source", "size", F.lit(0.0).alias("rate"))
    share = F.col("weight") / F.lit(float(total[1])) * F.lit(float(epochs * total[0]))
    return sizes.select("source", "size", F.when(F.col("size") > 0, F.round(share / F.col("size"), 9)).otherwise(0.0).alias("rate"))


def poisson_copies(docs: DataFrame, rates: DataFrame, seed: int, doc_id: str = "doc_id", source: str = "source", part: float = 16.0) -> DataFrame:
    """`docs` with __n_copies, the inverse Poisson distribution function at the document's hashed uniform numbers."""
    split = rates.select(
        F.col("source").alias("__source"),
        F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(part))).cast("int").alias("__parts"),
        (F.col("rate") / F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(part)))).alias("__mean"),
    )
    terms = int(part + 12 * math.sqrt(part) + 24)  # beyond, the distribution function is 1 in double precision
    # thresholds: the distribution function at 0, 1, 2, ...
    cdf = f"""aggregate(sequence(1, {terms}), named_struct('p', exp(-__mean), 'c', exp(-__mean), 'a', array(exp(-__mean))),
        (s, k) -> named_struct('p', s.p * __mean / k, 'c', s.c + s.p * __mean / k, 'a', array_append(s.a, s.c + s.p * __mean / k)), s -> s.a)"""
    split = split.selectExpr("__source", "__parts", f"{cdf} as __cdf")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        split = F.broadcast(split)
    joined = docs.join(split, docs[source].eqNullSafe(F.col("__source")), "left")
    uniform = f"cast(conv(substr(md5(concat('{seed}:', coalesce(cast({doc_id} as string), 'null'), ':', cast(j as string))), 1, 13), 16, 10) as double) / 4503599627370496D"
    count = f"aggregate(sequence(1, coalesce(__parts, 1)), 0, (n, j) -> n + size(filter(coalesce(__cdf, array(1D)), c -> c <= {uniform})))"
    return joined.withColumn("__n_copies", F.expr(count)).drop("__source", "__parts", "__cdf")


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.7, epochs: float = 1.0, seed: int = 7, position: bool = True) -> DataFrame:
    """Rows of `docs` repeated to the target weights, with `copy` (from 0) and their `position` in the global order.

    position: without it rows are only moved to random partitions, each in random order.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, targets, alpha, epochs)
    # inside, the columns of `docs` go by their places, so that no name of theirs meets one of ours
    names = [c for c in docs.columns if c.lower() not in OWN]
    doc_id, source = (f"c{next(i for i, c in enumerate(names) if c.lower() == n)}" for n in ("doc_id", "source"))
    rows = docs.select(*(F.col(f"`{c}`") for c in names)).toDF(*(f"c{i}" for i in range(len(names))))
    copies = poisson_copies(rows, rates, seed, doc_id, source).where("__n_copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n_copies") - 1))).drop("__n_copies")
    key = F.md5(F.concat(F.lit(f"{seed + 1}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.col("copy").cast("string")))
    copies = copies.withColumn("__key", key)
    if not position:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return copies.repartition(n, "__key").sortWithinPartitions("__key", doc_id, "copy").drop("__key").toDF(*names, "copy")
    # ranks by buckets of the key's first digits: uniform whatever the ids, about 50,000 rows each
    n = docs.count()
    digits = min(5, max(2, math.ceil(math.log(max(n * epochs / 50_000, 1), 16))))
    copies = copies.withColumn("__bucket", F.substring("__key", 1, digits))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = copies.groupBy("__bucket").agg(F.count("*").alias("n"))  # at most 16^digits rows
    starts = starts.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__bucket").orderBy("__key", doc_id, "copy")
    out = copies.withColumn("__k", F.row_number().over(inside)).join(F.broadcast(starts), F.col("__bucket") == F.col("__b"))
    out = out.select(*(f"c{i}" for i in range(len(names))), "copy", (F.col("__first") + F.col("__k") - 1).cast("long").alias("position"))
    return out.toDF(*names, "copy", "position")


def mixing_sql(alpha: float = 0.7, seed: int = 7, part: float = 16.0) -> str:
    """DuckDB SQL for doc_id, source, copy and position over the view `documents`."""
    terms = int(part + 12 * math.sqrt(part) + 24)
    return f"""
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS size, sum(CASE WHEN size > 0 THEN pow(size, {alpha}) ELSE 0 END) AS weight FROM sizes),
rates AS (SELECT source, CASE WHEN s.size > 0 THEN round(pow(s.size, {alpha}) / t.weight * t.size / s.size, 9) ELSE 0 END AS rate FROM sizes s, totals t),
split AS (SELECT source, greatest(1, CAST(ceil(rate / {part}) AS BIGINT)) AS parts, rate / greatest(1, ceil(rate / {part})) AS mean FROM rates),
cdf AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM split
  UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {terms}
),
lists AS (SELECT source, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, parts),
draws AS (
  SELECT d.doc_id, d.source, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cs, lambda c: c <=
    CAST(CAST('0x' || substr(md5(concat('{seed}:', coalesce(CAST(d.doc_id AS VARCHAR), 'null'), ':', CAST(j AS VARCHAR))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)))) AS n
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
),
copies AS (SELECT doc_id, source, CAST(unnest(range(0, CAST(n AS BIGINT))) AS INTEGER) AS copy FROM draws)
SELECT doc_id, source, copy,
  CAST(row_number() OVER (ORDER BY md5(concat('{seed + 1}:', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', CAST(copy AS VARCHAR))), doc_id, copy) - 1 AS BIGINT) AS position
FROM copies
"""
