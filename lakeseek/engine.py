"""The engine as one object: index a tree, query it, expand chunks, and look after the index."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import text
from .operators import cache as caches
from .operators import providers, search
from .sources.store import Store, index_path
from .sources.tree import git_branch, git_branches, git_root, indexable, scan


#: Cache events that are written at once, and files of the log beyond which it is rewritten.
EVENTS = 64


class Engine:
    """An index of the file tree at `root`."""

    def __init__(self, spark: SparkSession, root: str, path: str | None = None, profile: str | None = None, shared: bool = False):
        self.spark, self.root = spark, os.path.abspath(root)
        self.store = Store(spark, index_path(self.root, path, profile, shared))
        self.branch = git_branch(git_root(self.root) or self.root)
        self._cache = f"{self.store.path}/cache"
        self._events: list[tuple] = []
        self.fulltext_used: bool | None = None
        self.rerank_skipped: str | None = None

    # --- indexing ---

    def listing(self, exclude=None, include=None, detect: bool = True) -> DataFrame:
        return indexable(scan(self.spark, self.root, exclude, include), detect=detect)

    def index(self, exclude=None, include=None, detect: bool = True, **options) -> dict:
        files = self.listing(exclude, include, detect)
        return self.store.index(files.where("reason is null"), self.branch, **options)

    def clean(self) -> dict:
        return self.store.clean(self.listing().where("reason is null"), self.branch, git_branches(git_root(self.root) or self.root))

    # --- caches: append logs of Parquet, read by key ---

    def _entries(self, name: str, schema) -> DataFrame:
        fs, path = self.store._fs(f"cache/{name}")
        return self.spark.read.schema(schema).parquet(f"{self._cache}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self._cache}/{name}")

    def _event(self, level: str, event: str, saved: int | None = None) -> None:
        """Noted here; the log gets EVENTS of them at a time, or what there is when it is read or the session ends."""
        import datetime

        self._events.append((datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), level, event, saved, None))
        if len(self._events) >= EVENTS:
            self.flush()

    def flush(self) -> None:
        """Appends the noted cache events to the log; a log of many files is rewritten as one."""
        if not self._events:
            return
        rows, self._events = self._events, []
        self.spark.createDataFrame(rows, schemas.CACHE_EVENTS).coalesce(1).write.mode("append").parquet(f"{self._cache}/events")
        fs, path = self.store._fs("cache/events")
        if len(fs.listStatus(path)) > EVENTS:
            self._rewrite("events", self._entries("events", schemas.CACHE_EVENTS).coalesce(1))

    def _rewrite(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self._cache}/{name}.new")
        fs, path = self.store._fs(f"cache/{name}")
        fs.delete(path, True)
        fs.rename(self.store._fs(f"cache/{name}.new")[1], path)

    def cache_report(self, hours: int = 24) -> DataFrame:
        self.flush()
        return caches.report(self._entries("events", schemas.CACHE_EVENTS), F.current_timestamp() - F.make_dt_interval(hours=F.lit(hours)))

    def clear_cache(self) -> None:
        self._events.clear()
        fs, path = self.store._fs("cache")
        fs.delete(path, True)

    # --- queries ---

    def _vector(self, q: str, model: str, cached: bool) -> list[float]:
        import datetime

        key = self.spark.range(1).select(text.cache_key(F.lit(q), F.lit(model), F.lit(None))).first()[0]
        if cached:
            own = caches.live(self._entries("vectors", schemas.QUERY_CACHE).where(F.col("cache_key") == key), F.current_timestamp())
            row = own.orderBy(F.desc("created_at")).limit(1).collect()
            if row:
                self._event("L1", "hit", caches.SAVED_MS["L1"])
                return list(row[0]["embedding"])
            self._event("L1", "miss")
        vector = [float(x) for x in providers.embedder(model).embed([q])[0]]
        if cached:
            now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
            self._append("vectors", schemas.QUERY_CACHE, (key, q, model, vector, now, 0))
        return vector

    def _cached(self, name: str, schema, key: str, level: str, **match) -> list | None:
        """Cached (chunk_id, score) pairs of a key, newest first; hits and misses are logged."""
        own = self._entries(name, schema).where(F.col("cache_key") == key)
        for column, value in match.items():
            own = own.where(F.col(column) == value)
        row = own.orderBy(F.desc("created_at")).limit(1).collect()
        self._event(level, "hit" if row else "miss", caches.SAVED_MS[level] if row else None)
        return row[0] if row else None

    def _pairs(self, hits: DataFrame) -> list[tuple[int, float]]:
        return [(r["id"], r["score"]) for r in hits.select("id", "score", "rank").orderBy("rank").collect()]

    def _listed(self, pairs: list[tuple[int, float]], options: search.Options) -> DataFrame:
        """Ranked chunks from (id, score) pairs."""
        rows = self.spark.createDataFrame([(i, s, n + 1) for n, (i, s) in enumerate(pairs)], "id long, score double, rank long")
        return self.store.chunks(options.branch).join(F.broadcast(search.with_confidence(rows, options.thresholds)), "id").orderBy("rank")

    def _search(self, q: str, vector, options: search.Options, model: str, cached: bool) -> DataFrame:
        """Search through the result cache: entries hold for the index version, and the key has all that shapes a result."""
        import datetime

        chunks = self.store.chunks()
        # postings, unless the index is from before them: then texts are read
        index = (lambda branch: self.store.bm25(q, branch)) if self.store.has_full_text() else None
        if not cached:
            hits, self.fulltext_used = search.search(chunks, q, vector, options=options, index=index)
            return hits
        parts = (q, model, options.mode, options.top_k, options.branch, options.fusion, options.alpha, options.rrf_k, options.branch_first)
        key = self.spark.range(1).select(text.cache_key(*(F.lit(p) for p in parts))).first()[0]
        version = self.store.version
        row = self._cached("results", schemas.RESULT_CACHE, key, "L2", db_version=version)
        if row is None:
            hits, self.fulltext_used = search.search(chunks, q, vector, options=options, index=index)
            pairs = self._pairs(hits)
            now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
            self._append("results", schemas.RESULT_CACHE, (key, q, options.mode, options.top_k, version, pairs, self.fulltext_used, now, 0))
        else:
            pairs, self.fulltext_used = [tuple(p) for p in row["results"]], row["fts_available"]
        return self._listed(pairs, options)

    def _rerank(self, hits: DataFrame, q: str, options: search.Options, cached: bool) -> DataFrame:
        """Re-ranking through a cache keyed by the candidates' contents, in any order.

        What cannot re-rank leaves the hits as they are; `rerank_skipped` then says why, and nothing is cached.
        """
        import datetime

        if not cached:
            out, self.rerank_skipped = providers.rerank_or_keep(hits, q, options.rerank, options.rerank_top)
            return out
        first = hits.where(F.col("rank") <= options.rerank_top)
        known = {r["id"]: r["h"] for r in first.select("id", F.substring("text_sha256", 1, 16).alias("h")).collect()}
        content = self.spark.range(1).select(text.set_hash(F.array(*map(F.lit, known.values())) if known else F.array().cast("array<string>"))).first()[0]
        key = self.spark.range(1).select(text.cache_key(F.lit(q), F.lit(content), F.lit(options.rerank), F.lit(options.rerank_top))).first()[0]
        row = self._cached("reranked", schemas.RERANK_CACHE, key, "L3")
        if row is not None and {i for i, _ in row["results"]} == known.keys():
            return self._listed([tuple(p) for p in row["results"]], options)
        out, self.rerank_skipped = providers.rerank_or_keep(hits, q, options.rerank, options.rerank_top)
        if self.rerank_skipped:
            return out
        now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        self._append("reranked", schemas.RERANK_CACHE, (key, q, content, options.rerank, options.rerank_top, self._pairs(out), now, 0))
        return out

    def trim_cache(self) -> dict[str, int]:
        """First in, first out: rewrites each cache to its newest entries; counts of what went."""
        gone = {}
        for level, name, schema in (("L1", "vectors", schemas.QUERY_CACHE), ("L2", "results", schemas.RESULT_CACHE), ("L3", "reranked", schemas.RERANK_CACHE)):
            own = self._entries(name, schema)
            n = own.count()
            gone[level] = max(0, n - caches.MOST[level])
            if gone[level]:
                self._rewrite(name, caches.keep_newest(own, caches.MOST[level]))
        return gone

    def query(self, q: str, options: search.Options | None = None, model: str | None = None, cached: bool = True) -> DataFrame:
        """Ranked hits with score and confidence: search, path filter, re-ranking, then the cut to top_k."""
        q = search.check_query(q)
        options = search.options_from_env() if options is None else options
        model = providers.resolve_model(model or self.store.metadata("model") or None)
        options = replace(options, branch=options.branch or self.branch)
        vector = self._vector(q, model, cached) if options.mode != "fulltext" else None
        if vector is not None:
            search.check_dimensions(self.store.chunks(options.branch), len(vector))
        wanted = search.candidates_wanted(options.top_k, options.rerank_top if options.rerank else None, bool(options.include or options.exclude))
        hits = self._search(q, vector, replace(options, top_k=wanted), model, cached)
        if options.include or options.exclude:
            hits = search.rank_by(search.path_filter(hits, options.include, options.exclude).drop("rank"), "id")
        self.rerank_skipped = None
        if options.rerank:
            hits = self._rerank(hits, q, options, cached)
        return hits.where(F.col("rank") <= options.top_k).orderBy("rank")

    def text_lines(self, hits: DataFrame) -> DataFrame:
        """Hits as lines of text: path, lines, score, confidence, snippet."""
        line = F.format_string("%s:%d-%d  score=%.4f (%s)  %s", "path", "start_line", "end_line", "score", "confidence", text.snippet(F.col("text")))
        return hits.orderBy("rank").select(line.alias("line"))

    def results(self, hits: DataFrame) -> DataFrame:
        """Rows as they are shown: reference, rounded score, language and snippet."""
        from .functions import paths

        return hits.select(
            "rank", F.col("id").alias("chunk_id"), F.concat_ws(":", "path", F.col("chunk_index").cast("string")).alias("chunk_ref"), "path", "start_line", "end_line",
            F.round("score", 4).alias("score"), "confidence", paths.language(F.col("path")).alias("language"), text.snippet(F.col("text")).alias("snippet"),
        )

    def chunk(self, ref: str, before: int = 0, after: int = 0) -> DataFrame:
        chunks = self.store.chunks(self.branch)
        target = search.find_chunk(chunks, ref, self.branch)
        return search.neighbours(chunks, target, before, after, "path", "chunk_index").orderBy("chunk_index")
