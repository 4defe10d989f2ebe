"""Caches of query vectors, search results and re-rankings: lookups, validity, eviction and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_HOURS = 24
# Entries kept and milliseconds that a hit saves, by level.
MOST = {"L1": 1000, "L2": 500, "L3": 200}
SAVED_MS = {"L1": 350, "L2": 180, "L3": 3200}


def live(entries: DataFrame, now: Column, hours: int = TTL_HOURS, created: str = "created_at") -> DataFrame:
    """Entries younger than the time to live."""
    return entries.where(F.col(created) > now - F.make_dt_interval(hours=F.lit(hours)))


def valid(entries: DataFrame, version: int | Column) -> DataFrame:
    """Result entries of the index's current version."""
    return entries.where(F.col("db_version") == (version if isinstance(version, Column) else F.lit(version)))


def keep_newest(entries: DataFrame, most: int, created: str = "created_at", key: str = "cache_key") -> DataFrame:
    """First in, first out: the newest entries; ties by key. A limit over an order, not a window over all rows."""
    return entries.orderBy(F.desc(created), key).limit(most)


def report(events: DataFrame, since: Column | None = None) -> DataFrame:
    """(level, hits, misses, hit_rate, time_saved_ms) for each level and in all, of events after `since`."""
    own = events if since is None else events.where(F.col("timestamp") > since)
    levels = events.sparkSession.createDataFrame([("L1",), ("L2",), ("L3",)], "level string")
    hit, miss = F.col("event") == "hit", F.col("event") == "miss"
    sums = own.where(F.col("level").isin("L1", "L2", "L3")).groupBy("level").agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"), F.sum(F.when(hit, F.col("time_saved_ms"))).alias("saved"))
    full = levels.join(sums, "level", "left").select("level", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hits", "misses", "saved")))
    out = full.rollup("level").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum("saved").alias("time_saved_ms"))
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") * 100.0 / (F.col("hits") + F.col("misses"))).otherwise(0.0).cast("double")
    return out.select(F.coalesce("level", F.lit("total")).alias("level"), "hits", "misses", rate.alias("hit_rate"), "time_saved_ms")


def health(events: DataFrame, since: Column) -> DataFrame:
    """(level, lifetime and recent hits, misses and rates, time saved, oldest and newest event); rates are null without traffic."""
    hit, miss, recent = F.col("event") == "hit", F.col("event") == "miss", F.col("timestamp") > since
    out = events.groupBy("level").agg(
        F.count_if(hit).alias("lifetime_hits"), F.count_if(miss).alias("lifetime_misses"), F.count_if(hit & recent).alias("recent_hits"), F.count_if(miss & recent).alias("recent_misses"),
        F.coalesce(F.sum(F.when(hit, F.col("time_saved_ms"))), F.lit(0)).cast("long").alias("time_saved_ms"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"),
    )
    for kind in ("lifetime", "recent"):
        h, m = F.col(f"{kind}_hits"), F.col(f"{kind}_misses")
        out = out.withColumn(f"{kind}_hit_rate", F.when(h + m > 0, h * 100.0 / (h + m)).cast("double"))
    return out


def latest(entries: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key of an append log."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return entries.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
