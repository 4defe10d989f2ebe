"""Shared parts of the corpus operators: scratch tables, connected components, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python; whole texts ride in a batch, so it stays small.
BATCH_ROWS = 512


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; only where unset, one of our own (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("lakeseek.scratch", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="lakeseek-")
        spark.conf.set("lakeseek.scratch", root)
    return root.rstrip("/")


_OPEN: list["Scratch"] = []


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and survive lost executors.

    Results are lazy and read them, so they stay until `release` is called or the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/lakeseek-{uuid.uuid4().hex}"
        _OPEN.append(self)
        atexit.register(self._close)

    def _close(self) -> None:
        """At the driver's end, when no result can be read any more."""
        try:
            self.drop("")
        except Exception:  # the session ended before
            pass

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Deletes the intermediate tables of all operators called so far; call it once their results are written."""
    while _OPEN:
        _OPEN.pop()._close()


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Small Arrow batches from here on: plans are lazy, so the setting has to outlast the call that builds them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(run):
    """A batch function that gives free memory back after each task.

    Python workers are used again by later stages, so what one keeps adds to the next one's need.
    """

    def wrapped(batches):
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if raw[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = 4 << 20):
    """(first row, last row + 1) runs of rows of about `limit` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component): the smallest id reachable from each node that has a link.

    edges: two bigint columns a, b. Alternating large and small stars; each round is two aggregations and two joins
    over the edge list, written to the shared folder. Hubs are pre-aggregated and AQE splits their joins.
    """
    spark = scratch.spark
    cur = scratch.save(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}0",
    )

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]

    was, k = sign(cur), 0
    while was[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        nxt = scratch.save(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        now = sign(nxt)
        cur, done, was = nxt, now == was, now
        if done:
            break
    del spark
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
