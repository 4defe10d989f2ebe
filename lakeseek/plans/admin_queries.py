"""Queries of the index's upkeep: branches, differences, history, caches, snapshots, scans and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import cache, listing
from ..sources.store import Store
from ..sources.tree import TreeSource, indexable, scan
from ..streaming.refresh import refresh_stream
from .catalog import query, shared_folder, table
from .chunk_queries import windows_sql
from .scalar_queries import PATH, files

STATE = "sha256(text) AS sha256"


def indexed(spark, sf_dir):
    """Documents as the files of an index."""
    own = files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "doc_id")
    return own.withColumn("mtime_ns", F.col("doc_id") * 1000)


def listed(spark, sf_dir):
    """The same tree later: every tenth file gone, every seventh touched, every eleventh written anew."""
    own = indexed(spark, sf_dir).where("doc_id % 10 <> 0")
    own = own.withColumn("mtime_ns", F.when(F.col("doc_id") % 7 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")))
    return own.withColumn("sha256", F.when(F.col("doc_id") % 11 == 0, F.lit("new")).otherwise(F.col("sha256")))


@query("SELECT source AS branch, count(*) AS files FROM documents GROUP BY source")
def branch_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("branch").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "branch")


@query("SELECT DISTINCT source AS branch FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'default')")
def orphan_branches(spark, sf_dir):
    """Indexed branches that are no branches any more."""
    now = spark.createDataFrame([("src0",), ("src1",), ("src2",)], "branch string").union(spark.createDataFrame([("default",)], "branch string"))
    return files(spark, sf_dir).select("branch").distinct().join(now, "branch", "left_anti")


@query(f"SELECT {PATH} AS path FROM documents WHERE doc_id % 10 = 0")
def missing_files(spark, sf_dir):
    return indexed(spark, sf_dir).join(listed(spark, sf_dir).select("path"), "path", "left_anti").select("path")


@query(f"SELECT {PATH} AS path FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0")
def stale_files(spark, sf_dir):
    return listing.stale(listed(spark, sf_dir), indexed(spark, sf_dir)).select("path")


@query(f"SELECT {PATH} AS path, CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'modified' ELSE 'unchanged' END AS state FROM documents")
def incremental_diff(spark, sf_dir):
    return listing.differences(listed(spark, sf_dir), indexed(spark, sf_dir)).select("path", "state")


@query(f"SELECT {PATH} AS path FROM documents WHERE doc_id % 10 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0)")
def changed_files(spark, sf_dir):
    """What an incremental run has to index."""
    return listing.changed(listed(spark, sf_dir), indexed(spark, sf_dir)).select("path")


def history(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").alias("files_affected"))


@query("SELECT event_id AS id, event_type AS action, user_id AS files_affected FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def history_page(spark, sf_dir):
    return history(spark, sf_dir).orderBy(F.desc("timestamp"), F.desc("id")).offset(40).limit(20).drop("timestamp")


@query(f"SELECT event_id AS id, event_type AS action FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:30:00' AND event_type = (SELECT min(event_type) FROM events)")
def history_filter(spark, sf_dir):
    own = history(spark, sf_dir)
    first = own.agg(F.min("action").alias("action"))
    between = own.where("timestamp >= TIMESTAMP_NTZ '2024-01-05 00:00:00' and timestamp <= TIMESTAMP_NTZ '2024-01-20 12:30:00'")
    return between.join(F.broadcast(first), "action").select("id", "action")


@query("SELECT count(*) AS total, count(*) > 60 AS has_more, true AS has_prev FROM events")
def history_total(spark, sf_dir):
    return history(spark, sf_dir).agg(F.count("*").alias("total")).withColumns({"has_more": F.col("total") > 60, "has_prev": F.lit(True)})


def cache_events(spark, sf_dir):
    """Events as cache events: levels by user, hits and misses by id."""
    e = table(spark, sf_dir, "events")
    level = F.concat(F.lit("L"), (F.col("user_id") % 3 + 1).cast("string"))
    kind = F.when(F.col("event_id") % 4 == 0, "miss").when(F.col("event_id") % 4 == 3, "expire").otherwise("hit")
    return e.select(F.col("ts").alias("timestamp"), level.alias("level"), kind.alias("event"), (F.col("event_id") % 1000).alias("time_saved_ms"), "event_id")


_EVENTS = """e AS (SELECT ts, 'L' || CAST(user_id % 3 + 1 AS VARCHAR) AS level, CASE WHEN event_id % 4 = 0 THEN 'miss' WHEN event_id % 4 = 3 THEN 'expire' ELSE 'hit' END AS event, event_id % 1000 AS saved FROM events)"""


@query(
    f"""WITH {_EVENTS}, g AS (SELECT level, count_if(event = 'hit') AS hits, count_if(event = 'miss') AS misses, CAST(coalesce(sum(CASE WHEN event = 'hit' THEN saved END), 0) AS BIGINT) AS time_saved_ms FROM e WHERE ts > TIMESTAMP '2024-01-10 00:00:00' GROUP BY ROLLUP (level))
SELECT coalesce(level, 'total') AS level, CAST(hits AS BIGINT) AS hits, CAST(misses AS BIGINT) AS misses, CASE WHEN hits + misses > 0 THEN hits * 100.0::DOUBLE / (hits + misses) ELSE 0 END AS hit_rate, time_saved_ms FROM g"""
)
def cache_report(spark, sf_dir):
    return cache.report(cache_events(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"))


@query(
    f"""WITH {_EVENTS}, g AS (SELECT level, count_if(event = 'hit') AS lifetime_hits, count_if(event = 'miss') AS lifetime_misses, count_if(event = 'hit' AND ts > TIMESTAMP '2024-01-25 00:00:00') AS recent_hits,
  count_if(event = 'miss' AND ts > TIMESTAMP '2024-01-25 00:00:00') AS recent_misses, CAST(coalesce(sum(CASE WHEN event = 'hit' THEN saved END), 0) AS BIGINT) AS time_saved_ms FROM e GROUP BY level)
SELECT level, CAST(lifetime_hits AS BIGINT) AS lifetime_hits, CAST(lifetime_misses AS BIGINT) AS lifetime_misses, CAST(recent_hits AS BIGINT) AS recent_hits, CAST(recent_misses AS BIGINT) AS recent_misses, time_saved_ms,
  CASE WHEN lifetime_hits + lifetime_misses > 0 THEN lifetime_hits * 100.0::DOUBLE / (lifetime_hits + lifetime_misses) END AS lifetime_hit_rate, CASE WHEN recent_hits + recent_misses > 0 THEN recent_hits * 100.0::DOUBLE / (recent_hits + recent_misses) END AS recent_hit_rate FROM g"""
)
def cache_health(spark, sf_dir):
    return cache.health(cache_events(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")).drop("oldest", "newest")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 200")
def eviction_keep_n(spark, sf_dir):
    """The newest entries stay."""
    return cache.keep_newest(table(spark, sf_dir, "events"), cache.MOST["L3"], "ts", "event_id").select("event_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def ttl_live(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    both = e.crossJoin(F.broadcast(now))  # a single row
    return cache.live(both, F.col("now"), created="ts").select("event_id")


@query("SELECT event_id, user_id % 5 AS version FROM events WHERE user_id % 5 = 3")
def version_valid(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("db_version"))
    return cache.valid(e, 3).select("event_id", F.col("db_version").alias("version"))


@query("SELECT user_id AS key, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def metadata_latest(spark, sf_dir):
    """The newest value of each key of an append log."""
    e = table(spark, sf_dir, "events")
    return cache.latest(e.withColumn("o", F.struct("ts", "event_id")), "user_id", "o").select(F.col("user_id").alias("key"), "event_id")


def _write_tree(root: str) -> None:
    made = {"a.py": b"def f():\n    return 1\n", "__init__.py": b"X = 1\n", "_private.py": b"Y = 2\n", ".hidden.py": b"Z = 3\n", "_dir/x.py": b"W = 4\n", "empty.py": b"",
            "bad.py": b"ok \xff\xfe text\n", "bin.py": b"\0\1", "README.md": b"no", "node_modules/m.js": b"no"}
    for name, data in made.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    os.symlink(os.path.join(root, "a.py"), os.path.join(root, "z_link.py"))


@query(
    "SELECT path, CAST(n AS BIGINT) AS size, reason FROM (VALUES ('.hidden.py', 6, ''), ('__init__.py', 6, ''), ('_dir/x.py', 6, ''), ('_private.py', 6, ''), ('a.py', 22, ''), ('bad.py', 11, ''), ('bin.py', 2, 'binary')) t(path, n, reason)"
)
def tree_scan_counts(spark, sf_dir):
    """A small tree with the names that file readers hide: what is scanned, and why a file is left out.

    The tree is made on the driver, as its listing is; rows are few, so they are returned as a local frame.
    """
    with shared_folder(spark) as root:
        _write_tree(root)
        spark.dataSource.register(TreeSource)
        rows = indexable(scan(spark, root)).select("path", "size", F.coalesce("reason", F.lit("")).alias("reason")).collect()
    return spark.createDataFrame([tuple(r) for r in rows], "path string, size long, reason string")


_CHUNKED = windows_sql(30, 5, "doc_id, count(*) AS n") + " GROUP BY doc_id"
_STEP = "SELECT '{}' AS step, count(*) AS files, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks, CAST({} AS BIGINT) AS version FROM f WHERE {}"


@query(
    f"WITH f AS (SELECT d.doc_id, d.source, coalesce(n, 0) AS n FROM documents d LEFT JOIN ({_CHUNKED}) c ON d.doc_id = c.doc_id) "
    + " UNION ALL ".join(
        _STEP.format(*x)
        for x in (
            ("index", 1, "true"), ("index_again", 1, "true"), ("removed", 2, "doc_id % 10 <> 0"), ("delete", 3, "doc_id % 10 <> 0 AND source <> 'src1'"),
            ("clean", 4, "doc_id % 10 <> 0 AND source <> 'src1' AND doc_id % 2 = 0"),
        )
    )
)
def store_round_trip(spark, sf_dir):
    """An index in a folder, changed step by step: files, chunks and version after each."""
    docs = files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    tree = docs.select("path", "size", (F.col("doc_id") * 1000).alias("mtime_ns"), F.col("text").cast("binary").alias("content"), "doc_id")
    out = []
    with shared_folder(spark) as folder:
        store = Store(spark, folder)

        def note(step):
            s = store.status()
            out.append((step, s["files"], s["chunks"], s["version"]))

        store.index(tree, size=30, overlap=5)
        note("index")
        store.index(tree, size=30, overlap=5)
        note("index_again")
        store.index(tree.where("doc_id % 10 <> 0"), size=30, overlap=5)
        note("removed")
        store.delete(["src1/*"])
        note("delete")
        store.clean(tree.where("doc_id % 2 = 0"))
        note("clean")
    return spark.createDataFrame(out, "step string, files long, chunks long, version long")


@query("SELECT step, CAST(files AS BIGINT) AS files, CAST(files AS BIGINT) AS chunks, CAST(v AS BIGINT) AS version FROM (VALUES ('first', 6, 1), ('unchanged', 6, 1), ('added', 7, 2)) t(step, files, v)")
def stream_refresh_counts(spark, sf_dir):
    """A tree streamed into an index, then changed and streamed again."""
    out = []
    with shared_folder(spark) as base:
        root = os.path.join(base, "tree")
        os.makedirs(root)
        _write_tree(root)
        store = Store(spark, os.path.join(base, "index"))
        for step in ("first", "unchanged", "added"):
            if step == "added":
                with open(os.path.join(root, "_late.py"), "w") as f:
                    f.write("late = True\n")
            refresh_stream(spark, root, store, os.path.join(base, "checkpoint")).awaitTermination()
            s = store.status()
            out.append((step, s["files"], s["chunks"], s["version"]))
    return spark.createDataFrame(out, "step string, files long, chunks long, version long")
