"""Search: semantic, full-text and hybrid queries over chunks, and what follows them.

Chunks have a key, a text, a vector and any other columns. Scores are cut to the top on narrow rows, ranked, and joined
back to the wide ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, scores
from ..functions.vectors import dot
from . import fulltext

RERANK_TOP = 50


class SearchError(ValueError):
    """A query that cannot be answered; `code` names why."""

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Options:
    """How a query is answered."""

    top_k: int = 10
    mode: str = "hybrid"  # hybrid, semantic, fulltext
    fusion: str = "rrf"  # rrf, alpha
    alpha: float = scores.ALPHA
    rrf_k: int = scores.RRF_K
    branch: str | None = None
    branch_first: bool = False  # full text: filter by branch before the cut
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rerank: str | None = None
    rerank_top: int = RERANK_TOP
    thresholds: scores.Thresholds = field(default_factory=scores.Thresholds)


def options_from_env(env=None, **given) -> Options:
    """Options from LAKESEEK_ variables (SEARCH_MODE, FUSION_METHOD, HYBRID_ALPHA, RRF_K, RERANK_TOPN, CONF_*), then what is given."""
    import os

    env = os.environ if env is None else env
    read = lambda name, kind, default: kind(env.get(f"LAKESEEK_{name}", default))
    t = scores.DEFAULT
    levels = {f: read(f"CONF_{f.upper()}", float, getattr(t, f)) for f in ("strong", "expected", "weak", "high", "medium", "low", "high_share", "medium_share", "low_share")}
    base = {
        "mode": read("SEARCH_MODE", str, "hybrid"), "fusion": read("FUSION_METHOD", str, "rrf"), "alpha": read("HYBRID_ALPHA", float, scores.ALPHA),
        "rrf_k": read("RRF_K", int, scores.RRF_K), "rerank_top": read("RERANK_TOPN", int, RERANK_TOP), "thresholds": scores.Thresholds(**levels),
    }
    return Options(**(base | given))


def check_query(q: str) -> str:
    q = (q or "").strip()
    if len(q) < 2:
        raise SearchError("a query needs two characters at least", "QUERY_TOO_SHORT")
    return q


def check_dimensions(chunks: DataFrame, dim: int | None, vector: str = "embedding") -> None:
    """One dimension in the index, and the query's."""
    found = sorted(r[0] for r in chunks.select(F.size(vector).alias("d")).distinct().limit(3).collect())
    if not found:
        raise SearchError("the index is empty")
    if len(found) > 1:
        raise SearchError(f"the index mixes vector dimensions {found}", "MODEL_MISMATCH")
    if dim is not None and dim != found[0]:
        raise SearchError(f"query vectors have {dim} dimensions, the index {found[0]}", "MODEL_MISMATCH")


def semantic_scores(chunks: DataFrame, key: str, query: list[float] | DataFrame, vector: str = "embedding") -> DataFrame:
    """(key, score): dot products with one query vector, given as numbers or as a frame of one row `q`; rows without a vector have none."""
    if not isinstance(query, DataFrame):
        query = chunks.sparkSession.createDataFrame([([float(x) for x in query],)], "q array<double>")
    own = chunks.where(F.col(vector).isNotNull()).select(key, vector)
    return own.crossJoin(F.broadcast(query)).select(key, F.round(dot(F.col(vector), F.col("q")), 9).alias("score"))


def held(hits: DataFrame, most: int) -> DataFrame:
    """A cut list of at most `most` rows, computed once: its plan would run anew for each use otherwise."""
    rows = hits.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a cut list")
    return hits.sparkSession.createDataFrame(rows, hits.schema)


def knn_batch(vectors: DataFrame, key: str, queries: DataFrame, query_key: str, k: int, vector: str = "embedding", block: int = 2048, spread: int | None = None) -> DataFrame:
    """(query_key, key, score, rank): exact nearest neighbours of many queries by dot product.

    Queries are packed into rows of `block` vectors and vectors into rows of as many; each pair of packed rows is one matrix
    product, of which each query's best k leave the task. Packed vectors are dealt to `spread` groups (the shuffle partitions
    by default) and every group gets all queries, so any number of queries is answered in one plan and one pass over the
    vectors, and none of them passes through the driver.
    """
    name = query_key if query_key != key else "query_id"
    n = spread or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(queries, query_key, vector, block, "q").select("q_ids", "q_data", F.col("dim").alias("qdim"), groups.alias("qgroup"))
    right = _packed(vectors, key, vector, block, "k").withColumn("group", F.pmod(F.xxhash64("k_ids"), F.lit(n)).cast("int"))

    def best(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["k_ids"], "<i8")
                q = np.frombuffer(row["q_data"], "<f8").reshape(len(ids), -1)
                data = np.frombuffer(row["k_data"], "<f8").reshape(len(keys), -1)
                n = min(k, len(keys))
                for a in range(0, len(ids), 256):
                    sims = np.round(q[a : a + 256] @ data.T, 9)
                    cut = np.partition(sims, -n, axis=1)[:, -n]
                    i, at = np.nonzero(sims >= cut[:, None])
                    score = sims[i, at]
                    order = np.lexsort((keys[at], -score, i))
                    i, at, score = i[order], at[order], score[order]
                    first = np.searchsorted(i, np.arange(sims.shape[0]))
                    top = np.arange(len(i)) - first[i] < n
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + i[top]]), pa.array(keys[at[top]]), pa.array(score[top])], ["q", "k", "score"])

    pairs = right.join(left, (F.col("dim") == F.col("qdim")) & (F.col("group") == F.col("qgroup"))).select("q_ids", "q_data", "k_ids", "k_data")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "k")
    top = pairs.mapInArrow(best, "q long, k long, score double").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(name), F.col("k").alias(key), "score", "rank")


def _packed(vectors: DataFrame, key: str, vector: str, rows: int, name: str) -> DataFrame:
    """(name_ids, name_data, dim): runs of up to `rows` vectors of one length as bytes, made where they lie."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            keys = batch.column(0).to_numpy()
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.nonzero(sizes == dim)[0]
                data = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(at), dim)
                held.setdefault(dim, []).append((keys[at].astype("<i8"), data))
                if sum(len(x[0]) for x in held[dim]) >= rows:
                    yield from send(dim, held.pop(dim))
        for dim, parts in held.items():
            yield from send(dim, parts)

    def send(dim, parts):
        ids, data = (np.concatenate(x) for x in zip(*parts))
        for a in range(0, len(ids), rows):
            yield pa.RecordBatch.from_arrays([pa.array([ids[a : a + rows].tobytes()]), pa.array([data[a : a + rows].tobytes()]), pa.array([dim], pa.int32())], [f"{name}_ids", f"{name}_data", "dim"])

    good = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    return good.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, f"{name}_ids binary, {name}_data binary, dim int")


def rank_by(hits: DataFrame, key: str, score: str = "score") -> DataFrame:
    """1-based rank by descending score, ties by key. For cut lists: the window has one partition."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), key)).cast("long"))


def rank_all(rows: DataFrame, key: str, score: str = "score", parts: int = 64) -> DataFrame:
    """1-based rank by descending score, ties by key, of any number of rows.

    Rows are cut into ranges of the score at approximate quantiles; a rank is the row's number in its range after the
    sizes of the ranges above. Two passes, and no range is more than a few hundredths of the rows unless scores are equal.
    """
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(rows.approxQuantile(score, shares, 0.25 / parts)), reverse=True) if shares else []
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col(score))) if cuts else F.lit(0)
    own = rows.withColumn("__range", above)
    sizes = dict(own.groupBy("__range").agg(F.count("*")).collect())  # at most `parts` rows
    first, at = [], 0
    for i in range(len(cuts) + 1):
        first.append(at)
        at += sizes.get(i, 0)
    number = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc(score), key))
    start = F.element_at(F.array(*(F.lit(x).cast("long") for x in first)), F.col("__range") + 1)
    return own.withColumn("rank", (start + number).cast("long")).drop("__range")


def with_top(hits: DataFrame, name: str = "__top") -> DataFrame:
    """Adds the best score of all rows: one aggregated row, joined back."""
    return hits.crossJoin(F.broadcast(hits.agg(F.max("score").alias(name))))


def with_confidence(hits: DataFrame, t: scores.Thresholds = scores.DEFAULT, cut: bool = True) -> DataFrame:
    """Adds confidence, relative_pct, absolute_quality and signal to a ranked list; the last three are null without a top.

    cut: the list is a short one, whose top a window finds; any other is read twice.
    """
    own = hits.withColumn("__top", F.max("score").over(Window.partitionBy(F.lit(1)))) if cut else with_top(hits)
    s, m, r = F.col("score"), F.col("__top"), F.col("rank")
    positive = m > 0
    return own.withColumns(
        {
            "confidence": scores.level(s, m, r, t),
            "relative_pct": F.when(positive, F.round(scores.percent(s, m), 1) + F.lit(0.0)),
            "absolute_quality": F.when(positive, scores.band(s, t)),
            "signal": F.when(positive, scores.signal(s, m, r, t)),
        }
    ).drop("__top")


def fuse(semantic: DataFrame, full: DataFrame, key: str, options: Options) -> DataFrame:
    """(key, score): the full outer join of both lists; a row that one list lacks gets nothing from it.

    full: the full-text hits, a short list. The semantic list is ranked as a whole, but RRF needs ranks of the rows that the
    other list holds and of the best only: any other row can be in the result only if its rank is at most top_k.
    """
    if options.fusion == "alpha":
        fused = F.round(scores.alpha_fusion(F.col("score"), F.col("fts_score"), options.alpha), 12).alias("score")
        both = semantic.join(F.broadcast(full.select(key, "fts_score")), key, "left").select(key, "score", "fts_score")
        alone = full.join(semantic.join(F.broadcast(full.select(key)), key, "left_semi").select(key), key, "left_anti")
        return both.unionByName(alone.select(key, F.lit(None).cast("double").alias("score"), "fts_score")).select(key, fused)
    # at most top_k rows, and those of the full-text list
    top = {r[key]: i + 1 for i, r in enumerate(semantic.orderBy(F.desc("score"), key).limit(options.top_k).collect())}
    found = {r[key]: r["fts_rank"] for r in full.collect()}
    near = semantic.join(F.broadcast(full.select(key)), key, "left_semi").collect()
    if near:
        # a hit's rank is one more than the rows before it: all counted in one aggregation
        before = [(F.col("score") > h["score"]) | ((F.col("score") == h["score"]) & (F.col(key) < h[key])) for h in near]
        counts = semantic.agg(*(F.count_if(c).alias(str(i)) for i, c in enumerate(before))).first()
        top |= {h[key]: n + 1 for h, n in zip(near, counts)}
    kind = semantic.schema[key].dataType.simpleString()
    ranks = semantic.sparkSession.createDataFrame([(i, top.get(i), found.get(i)) for i in {**top, **found}], f"`{key}` {kind}, r long, fts_rank long")
    return ranks.select(key, F.round(scores.rrf(F.col("r"), F.col("fts_rank"), k=options.rrf_k), 9).alias("score"))


def search(
    chunks: DataFrame, query: str, vector, key: str = "id", text: str = "text", embedding: str = "embedding", branch: str = "branch", options: Options = Options(),
    index: Callable[[str | None], DataFrame] | None = None,
) -> tuple[DataFrame, bool]:
    """(hits, full text used): the top rows of `chunks` with score, rank and confidence.

    Full text scores and cuts over all branches before the branch is filtered, unless options.branch_first. A hybrid query
    without full-text hits gives plain cosines. index: BM25 scores (key, bm25) of a stored index, for one branch or None
    for all; without it the texts are read. Either way full text runs once, and its cut list is kept on the driver.
    """
    mine = chunks.where(F.col(branch) == options.branch) if options.branch is not None else chunks
    scope = mine if options.branch_first else chunks
    used = options.mode != "semantic"
    full = None
    if used:
        cut = options.top_k if options.mode == "fulltext" else 2 * options.top_k
        scored = index(options.branch if options.branch_first else None) if index else fulltext.bm25(scope, key, query, text)
        full = held(fulltext.ranked(scored, key, cut), 2 * cut)
    if options.mode == "fulltext":
        listed = mine.select(key).join(F.broadcast(full), key).select(key, F.col("fts_score").alias("score"))
    else:
        listed = semantic_scores(mine, key, vector, embedding)
        used = used and not full.isEmpty()
        if used:
            own = full.join(mine.select(key), key, "left_semi") if options.branch is not None and not options.branch_first else full
            listed = fuse(listed, held(own, 4 * options.top_k), key, options)
    best = held(listed.orderBy(F.desc("score"), key).limit(options.top_k), options.top_k)
    ranked = with_confidence(rank_by(best, key), options.thresholds)
    return mine.join(F.broadcast(ranked), key).orderBy("rank"), used


def path_filter(hits: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), root: str = "", path: str = "path") -> DataFrame:
    """Hits whose path, below the root or as a whole, matches an include (if any) and no exclude."""
    p = F.col(path)
    below = F.when(F.startswith(p, F.lit(root.rstrip("/") + "/")), paths.relative(p, root)).otherwise(paths.last_two(p)) if root else p
    keep = F.lit(True)
    if include:
        keep = keep & (paths.matches_any(below, list(include)) | paths.matches_any(p, list(include)))
    if exclude:
        keep = keep & ~(paths.matches_any(below, list(exclude)) | paths.matches_any(p, list(exclude)))
    return hits.where(keep)


def filter_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """(candidates_before, candidates_after, removal_pct, method, warning): a warning above half removed."""
    b, a = before.agg(F.count("*").alias("candidates_before")), after.agg(F.count("*").alias("candidates_after"))
    pct = F.when(F.col("candidates_before") > 0, (F.col("candidates_before") - F.col("candidates_after")) * 100.0 / F.col("candidates_before")).otherwise(0.0)
    both = b.crossJoin(a).withColumn("removal_pct", F.round(pct.cast("double"), 1))
    warning = F.when(F.col("removal_pct") > 50, F.concat(F.lit("path filter removed "), F.format_string("%.0f", "removal_pct"), F.lit("% of candidates")))
    return both.withColumns({"method": F.lit("fnmatch_postfilter"), "warning": warning})


def candidates_wanted(top_k: int, rerank_top: int | None = None, filtered: bool = False) -> int:
    """How many hits to fetch for what follows."""
    n = max(top_k, rerank_top or 0)
    return max(n, 3 * top_k) if filtered else n


def summarise(hits: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """One row for each file of a hit list: matches, best and least score, confidence, language, line ranges."""
    own = hits.withColumn("__top", F.max("score").over(Window.partitionBy(F.lit(1))))
    files = own.groupBy(path).agg(
        F.count("*").alias("chunks_matched"), F.max("score").alias("best"), F.min("score").alias("least"), F.max("__top").alias("top"),
        F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("lines_covered"),
    )
    return files.select(
        path, paths.relative(F.col(path), root).alias("relative_path") if root else F.col(path).alias("relative_path"), "chunks_matched",
        F.round("best", 4).alias("best_score"), F.round("least", 4).alias("min_score"), scores.level(F.col("best"), F.col("top"), F.lit(1)).alias("confidence"),
        paths.language(F.col(path)).alias("language"), "lines_covered",
    ).orderBy(F.desc("best_score"), path)


def histogram(hits: DataFrame) -> DataFrame:
    """(confidence, n) with a row for each of the four levels."""
    levels = hits.sparkSession.createDataFrame([(x,) for x in ("high", "medium", "low", "very_low")], "confidence string")
    return levels.join(hits.groupBy("confidence").agg(F.count("*").alias("n")), "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).alias("n"))


def neighbours(chunks: DataFrame, targets: DataFrame, before: int, after: int, group: str, index: str) -> DataFrame:
    """Chunks of the targets' group within `before` and `after` of their index, with the distance.

    Each target becomes a row for each index it wants, so the join is an equi-join that Spark broadcasts only if the targets
    are few and otherwise deals out by group and index: a large group is spread over its indexes.
    """
    t = targets.select(F.col(group).alias("__g"), F.col(index).alias("target_index"))
    t = t.withColumn("__i", F.explode(F.sequence(F.col("target_index") - before, F.col("target_index") + after)))
    both = chunks.join(t, (F.col(group) == F.col("__g")) & (F.col(index) == F.col("__i")))
    return both.withColumn("distance", (F.col(index) - F.col("target_index")).cast("long")).drop("__g", "__i")


def find_chunk(chunks: DataFrame, ref: str, branch: str | None = None, key: str = "id") -> DataFrame:
    """The chunk of an id or of "path:index", in one branch if given."""
    path, number = paths.chunk_ref(ref)
    own = chunks.where(F.col("branch") == branch) if branch else chunks
    if path is None:
        return own.where(F.col(key) == number)
    if number is None:
        raise SearchError(f"{ref!r} names no chunk: expected an id or path:index")
    return own.where((F.col("chunk_index") == number) & (F.endswith("path", F.lit("/" + path)) | (F.col("path") == path)))
