"""Incremental refresh of an index by Structured Streaming over a file tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store
from ..sources.tree import TreeSource, first_of_links, indexable, names, scan, select_files


def refresh_stream(
    spark: SparkSession, root: str, store: Store, checkpoint: str, branch: str = "default", every: str | None = None, **options
) -> StreamingQuery:
    """Starts a query whose batches hold the files changed since the last one.

    every: a processing-time interval; without it the query takes what is there and ends. A batch indexes its own files, and
    a listing of names tells which of the index are gone; a batch run again changes nothing. Files that are only deleted are
    noticed with the next change, or by `refresh_if_stale`. Chunk settings are those the index was made with.
    """
    spark.dataSource.register(TreeSource)
    changed = select_files(spark.readStream.format("tree").option("path", root).load(), root)
    meta = store.metadata()
    settings = {"chunker": meta.get("chunker", "lines"), "size": int(meta.get("size", 60)), "overlap": int(meta.get("overlap", 10))} | options

    def batch(files: DataFrame, number: int) -> None:
        store.index(indexable(first_of_links(files)).where("reason is null"), branch, whole=False, action="refresh", **settings)
        store.forget(names(files.sparkSession, root), branch)

    writer = changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def refresh_if_stale(spark: SparkSession, root: str, store: Store, branch: str = "default") -> dict:
    """Runs the batch once, before a query."""
    listed = indexable(scan(spark, root)).where("reason is null")
    meta = store.metadata()
    return store.index(listed, branch, chunker=meta.get("chunker", "lines"), size=int(meta.get("size", 60)), overlap=int(meta.get("overlap", 10)), action="refresh")


def event_counts(events: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Counts of a stream by tumbling window, closed `late` after the newest event time."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
