"""Queries of full-text, vector and hybrid search, and of retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, fulltext, providers, search
from .catalog import query, table
from .chunk_queries import TOKENS

ONE, TWO, PHRASE = "the", "of the", "in-the"


def bm25_sql(terms: list[list[str]], name: str = "b") -> str:
    """Common table expressions that end in {name}(doc_id, source, bm25) for phrases of one token or two."""
    tf = []
    for p in terms:
        if len(p) == 1:
            tf.append(f"len(list_filter(t, lambda x: x = '{p[0]}'))")
        else:
            tf.append(f"len(list_filter(range(1, len(t)), lambda i: t[i] = '{p[0]}' AND t[i + 1] = '{p[1]}'))")
    cols = ", ".join(f"{x} AS tf{i}" for i, x in enumerate(tf))
    freq = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms))
    )
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""k AS (SELECT doc_id, source, {TOKENS} AS t FROM documents), f AS (SELECT doc_id, source, CAST(len(t) AS DOUBLE) AS len, {cols} FROM k),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean, {freq} FROM f), {name} AS (SELECT doc_id, source, round({score}, 9) AS bm25 FROM f, st WHERE {every})"""


def ranked_sql(name: str, most: int, out: str) -> str:
    return f"""{out} AS (SELECT doc_id, source, bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS fts_rank,
  (bm25 - min(bm25) OVER ()) / CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 1 ELSE max(bm25) OVER () - min(bm25) OVER () END AS fts_score
  FROM (SELECT * FROM {name} ORDER BY bm25 DESC, doc_id LIMIT {most}))"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def _top(spark, sf_dir, q):
    out = fulltext.ranked(fulltext.bm25(docs(spark, sf_dir), "doc_id", q), "doc_id", 10)
    return out.select("doc_id", F.round("bm25", 6).alias("bm25"), "fts_rank", F.round("fts_score", 6).alias("fts_score"))


_TOP = "SELECT doc_id, round(bm25, 6) AS bm25, fts_rank, round(fts_score, 6) AS fts_score FROM r"


@query(f"WITH {bm25_sql([['ist']])}, {ranked_sql('b', 20, 'r')} {_TOP}")
def bm25_single(spark, sf_dir):
    return _top(spark, sf_dir, "ist")


@query(f"WITH {bm25_sql([['of'], ['the']])}, {ranked_sql('b', 20, 'r')} {_TOP}")
def bm25_and(spark, sf_dir):
    """All terms have to be there; such common ones have the least weight there is."""
    return _top(spark, sf_dir, TWO)


@query(f"WITH {bm25_sql([['for', 'the'], ['is']])}, {ranked_sql('b', 20, 'r')} {_TOP}")
def bm25_phrase(spark, sf_dir):
    """A term with punctuation is a phrase."""
    return _top(spark, sf_dir, "for-the is")


@query(f"WITH {bm25_sql([['for', 'the'], ['is']])} SELECT doc_id, round(bm25, 6) AS bm25 FROM b")
def bm25_index(spark, sf_dir):
    """The same scores from the inverted index."""
    own = docs(spark, sf_dir)
    out = fulltext.bm25_from_postings(fulltext.postings(own, "doc_id"), fulltext.document_lengths(own, "doc_id"), "doc_id", "for-the is")
    return out.select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {bm25_sql([['is']])}, {ranked_sql('b', 20, 'r')}, own AS (SELECT * FROM r WHERE source = 'src0') SELECT doc_id, round(fts_score, 6) AS score, row_number() OVER (ORDER BY fts_score DESC, doc_id) AS rank FROM own ORDER BY fts_score DESC, doc_id LIMIT 10")
def bm25_branch_filtered(spark, sf_dir):
    """Full-text mode: cut and scaled over all branches, then filtered."""
    own = docs(spark, sf_dir).withColumn("embedding", F.array(F.lit(0.0)))
    hits, _ = search.search(own, "is", None, "doc_id", branch="source", options=search.Options(mode="fulltext", branch="src0"))
    return hits.select("doc_id", F.round("score", 6).alias("score"), "rank")


_DOT = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9)"


@query(f"SELECT e.vec_id, {_DOT} AS score, row_number() OVER (ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    best = search.semantic_scores(e, "vec_id", q).orderBy(F.desc("score"), "vec_id").limit(10)
    return search.rank_by(best, "vec_id")


@query(
    f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5"""
)
def knn_topk_batch(spark, sf_dir):
    """Every fiftieth vector against all, as matrix products."""
    e = table(spark, sf_dir, "embeddings")
    out = search.knn_batch(e, "vec_id", e.where("vec_id % 50 = 0"), "vec_id", 5)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT e.vec_id, {_DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_DOT} >= 0.2")
def knn_min_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    return search.semantic_scores(e, "vec_id", q).where("score >= 0.2")


def corpus(spark, sf_dir):
    """All documents as chunks, with the vector of their id where there is one; the others take part in full text only."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs(spark, sf_dir).join(e, "doc_id", "left")


def _query_vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id = 0")
    return e.select(F.transform("embedding", lambda x: x.cast("double")).alias("q"))


_SEM = "s AS (SELECT e.vec_id AS doc_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id IN (SELECT doc_id FROM documents))"
_BM = bm25_sql([["and"], ["is"]])
_LEVEL = """o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, max(score) OVER () AS top FROM (SELECT * FROM u ORDER BY score DESC, doc_id LIMIT 10)),
p AS (SELECT *, CASE WHEN top > 0 THEN score / top * 100 ELSE 0 END AS pct, CASE WHEN score >= 0.5 THEN 'strong' WHEN score >= 0.35 THEN 'expected_range' WHEN score >= 0.25 THEN 'weak' ELSE 'very_weak' END AS band FROM o)
SELECT doc_id, score, rank, CASE WHEN top <= 0 THEN CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.3 THEN 'low' ELSE 'very_low' END
  WHEN pct >= 90 AND band IN ('strong', 'expected_range') THEN 'high' WHEN pct >= 90 AND band = 'weak' THEN 'medium' WHEN pct >= 90 THEN CASE WHEN rank = 1 THEN 'medium' ELSE 'low' END
  WHEN pct >= 75 OR band = 'expected_range' THEN 'medium' WHEN pct >= 50 OR band = 'weak' THEN 'low' ELSE 'very_low' END AS confidence FROM p"""


def _hybrid(spark, sf_dir, q, **options):
    hits, _ = search.search(corpus(spark, sf_dir), q, _query_vector(spark, sf_dir), "doc_id", branch="source", options=search.Options(**options))
    return hits.select("doc_id", "score", "rank", "confidence")


@query(
    f"""WITH {_BM}, {ranked_sql('b', 40, 'r')}, {_SEM}, g AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS sr FROM s),
u AS (SELECT coalesce(g.doc_id, r.doc_id) AS doc_id, round(coalesce(1::DOUBLE / (60 + sr), 0) + coalesce(1::DOUBLE / (60 + fts_rank), 0), 9) AS score FROM g FULL JOIN r ON g.doc_id = r.doc_id), {_LEVEL}"""
)
def hybrid_rrf(spark, sf_dir):
    """The default search: reciprocal rank fusion of vectors and full text."""
    return _hybrid(spark, sf_dir, "and is")


@query(f"WITH {_BM}, {ranked_sql('b', 40, 'r')}, {_SEM}, u AS (SELECT coalesce(s.doc_id, r.doc_id) AS doc_id, round(0.7::DOUBLE * coalesce(score, 0) + (1 - 0.7::DOUBLE) * coalesce(fts_score, 0), 12) AS score FROM s FULL JOIN r ON s.doc_id = r.doc_id), {_LEVEL}")
def hybrid_alpha(spark, sf_dir):
    return _hybrid(spark, sf_dir, "and is", fusion="alpha")


@query(f"WITH {_SEM}, u AS (SELECT * FROM s), {_LEVEL}")
def hybrid_no_fts_fallback(spark, sf_dir):
    """Without full-text hits the scores are plain cosines."""
    return _hybrid(spark, sf_dir, "zzzqqqxxx")


@query(f"WITH {_SEM}, u AS (SELECT s.* FROM s JOIN documents d ON s.doc_id = d.doc_id WHERE d.source = 'src0'), {_LEVEL}")
def semantic_branch(spark, sf_dir):
    return _hybrid(spark, sf_dir, "anything", mode="semantic", branch="src0")


@query(
    f"""WITH {_SEM}, t AS (SELECT s.doc_id, score, (s.doc_id // 3) AS file FROM s JOIN documents d ON s.doc_id = d.doc_id ORDER BY score DESC, s.doc_id LIMIT 60)
SELECT 'f' || CAST(file AS VARCHAR) || '.py' AS path, count(*) AS chunks_matched, round(max(score), 4) AS best_score, round(min(score), 4) AS min_score, 'python' AS language,
  string_agg(CAST(doc_id * 10 AS VARCHAR) || '-' || CAST(doc_id * 10 + 9 AS VARCHAR), ',' ORDER BY doc_id) AS lines FROM t GROUP BY file"""
)
def file_summary(spark, sf_dir):
    """A hit list by file; three neighbouring documents stand for one file's chunks."""
    s = search.semantic_scores(corpus(spark, sf_dir), "doc_id", _query_vector(spark, sf_dir)).orderBy(F.desc("score"), "doc_id").limit(60)
    path = F.concat(F.lit("f"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit(".py"))
    hits = s.select("doc_id", "score", path.alias("path"), (F.col("doc_id") * 10).alias("start_line"), (F.col("doc_id") * 10 + 9).alias("end_line"))
    lines = F.array_join(F.transform("lines_covered", lambda x: F.concat_ws("-", x["start_line"].cast("string"), x["end_line"].cast("string"))), ",")
    return search.summarise(hits).select("path", "chunks_matched", "best_score", "min_score", "language", lines.alias("lines"))


@query(
    """SELECT c.conv_id, t.turn AS target_index, c.turn, CAST(c.turn - t.turn AS BIGINT) AS distance, c.role FROM conversations c JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn = 2) t
ON c.conv_id = t.conv_id AND c.turn BETWEEN t.turn - 1 AND t.turn + 2"""
)
def neighbor_context(spark, sf_dir):
    """One chunk before and two after a target."""
    c = table(spark, sf_dir, "conversations")
    targets = c.where("turn = 2").select("conv_id", "turn").distinct()
    return search.neighbours(c, targets, 1, 2, "conv_id", "turn").select("conv_id", "target_index", "turn", "distance", "role")


@query(
    """SELECT conv_id, turn, role, array_to_string(list(role) OVER w, '>') AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""
)
def neighbor_window(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = search.Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-1, 1)
    return c.select("conv_id", "turn", "role", F.array_join(F.collect_list("role").over(w), ">").alias("context"))


# --- quality: the first vector of each label asks for its label ---

_RUN = """q AS (SELECT label, min(vec_id) AS qid FROM embeddings GROUP BY label),
n AS (SELECT q.label AS query_id, e.vec_id, e.label, row_number() OVER (PARTITION BY q.label ORDER BY {order}) AS rank
  FROM q JOIN embeddings v ON v.vec_id = q.qid CROSS JOIN embeddings e WHERE e.vec_id <> q.qid),
k AS (SELECT q.label AS query_id, min(n.rank) AS rank FROM q LEFT JOIN n ON n.query_id = q.label AND n.label = q.label AND n.rank <= 10 GROUP BY 1)"""
_BY_DOT = _RUN.format(order="round(list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, e.vec_id")
_BY_FIRST = _RUN.format(order="round(e.embedding[1]::DOUBLE * v.embedding[1]::DOUBLE, 9) DESC, e.vec_id")


def _ranks(spark, sf_dir, dims=None):
    e = table(spark, sf_dir, "embeddings")
    if dims:
        e = e.withColumn("embedding", F.slice("embedding", 1, dims))
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    asked = e.join(first.select("vec_id"), "vec_id", "left_semi")
    near = search.knn_batch(e, "vec_id", asked, "vec_id", 11)  # itself and ten more
    own = near.join(e.select("vec_id", "label"), "vec_id").join(first.select(F.col("label").alias("want"), F.col("vec_id").alias("query_id")), "query_id")
    own = own.where(F.col("vec_id") != F.col("query_id"))
    order = search.Window.partitionBy("query_id").orderBy("rank")
    own = own.withColumn("rank", F.row_number().over(order).cast("long"))
    hit = own.where((F.col("label") == F.col("want")) & (F.col("rank") <= 10)).groupBy("want").agg(F.min("rank").alias("rank"))
    return first.select(F.col("label").alias("query_id")).join(hit.withColumnRenamed("want", "query_id"), "query_id", "left")


@query(f"WITH {_BY_DOT} SELECT count(*) AS n, CAST(count_if(rank <= 1) AS BIGINT) AS hit_at_1, CAST(count_if(rank <= 3) AS BIGINT) AS hit_at_3, CAST(count_if(rank <= 5) AS BIGINT) AS hit_at_5, round(avg(coalesce(1::DOUBLE / rank, 0)), 6) AS mrr FROM k")
def hit_at_k_mrr(spark, sf_dir):
    out = evaluate.metrics(_ranks(spark, sf_dir))
    return out.withColumn("mrr", F.round("mrr", 6))


@query(
    f"""WITH a AS (WITH {_BY_FIRST} SELECT * FROM k), b AS (WITH {_BY_DOT} SELECT * FROM k)
SELECT query_id, a.rank AS base_rank, b.rank AS new_rank, a.rank - b.rank AS lift, CASE WHEN a.rank IS NULL AND b.rank IS NULL THEN 'none' WHEN a.rank IS NULL THEN 'NEW' WHEN b.rank IS NULL THEN 'LOST'
  WHEN b.rank < a.rank THEN 'improved' WHEN b.rank = a.rank THEN 'unchanged' ELSE 'degraded' END AS outcome FROM a FULL JOIN b USING (query_id)"""
)
def rank_lift(spark, sf_dir):
    """From ranking by one dimension to ranking by all."""
    return evaluate.lift(_ranks(spark, sf_dir, 1), _ranks(spark, sf_dir))


@query(f"WITH {_BY_DOT} SELECT round(avg(CASE WHEN rank <= 5 THEN (6 - rank) / 5.0::DOUBLE ELSE 0 END), 6) AS accuracy, CAST(count_if(rank <= 5) AS BIGINT) AS hits FROM k")
def tune_accuracy(spark, sf_dir):
    return evaluate.weighted_accuracy(_ranks(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    """WITH r AS (SELECT event_type AS model, CAST(30 * (1 + user_id % 4) AS INTEGER) AS chunk_lines, CAST(5 * (1 + event_id % 3) AS INTEGER) AS overlap, round(avg(value), 6) AS accuracy, count(*) AS hits, CAST(min(event_id) AS DOUBLE) AS seconds FROM events GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, chunk_lines, overlap) AS i, avg(seconds) OVER (PARTITION BY model) AS m FROM r)
SELECT model, chunk_lines, overlap, accuracy, hits, round(m, 6) AS mean_seconds FROM b WHERE i = 1"""
)
def benchmark_best(spark, sf_dir):
    """The best setting of each model of a grid."""
    e = table(spark, sf_dir, "events")
    r = e.groupBy(
        F.col("event_type").alias("model"), (30 * (1 + F.col("user_id") % 4)).cast("int").alias("chunk_lines"), (5 * (1 + F.col("event_id") % 3)).cast("int").alias("overlap")
    ).agg(F.round(F.avg("value"), 6).alias("accuracy"), F.count("*").alias("hits"), F.min("event_id").cast("double").alias("seconds"))
    return evaluate.best_by_model(r).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query(
    f"""WITH w AS (SELECT list_distinct(list_filter(regexp_split_to_array(strip_accents(lower((SELECT text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)))), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')) AS q),
h AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, {TOKENS} AS t FROM documents),
s AS (SELECT doc_id, rank, round(CAST(len(list_intersect(q, t)) AS DOUBLE) / len(q), 9) AS score FROM h, w WHERE rank <= 50)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, rank) AS rank FROM s ORDER BY score DESC, s.rank LIMIT 10"""
)
def rerank_topn_trim(spark, sf_dir):
    """The fifty longest documents scored anew by the tokens they share with a query; ten stay."""
    q = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    hits = d.withColumn("rank", F.row_number().over(search.Window.partitionBy(F.lit(1)).orderBy(F.desc("n_chars"), "doc_id")).cast("long"))
    return providers.rerank(hits, q, top=50, key="doc_id", keep=10).select("doc_id", "score", "rank")


_MODELS = ", ".join(f"('{m.id}', {m.dimensions}, {m.price}::DOUBLE, {m.context}, {m.batch})" for m in providers.MODELS.values())
_ALIASES = ", ".join(f"('{i}', '{a}', {100 * len(a) + k})" for k, (a, i) in enumerate(providers.ALIASES.items()))


@query(
    f"""SELECT m.id, m.dimensions, m.price, m.context, m.batch, a.alias FROM (VALUES {_MODELS}) m(id, dimensions, price, context, batch)
LEFT JOIN (SELECT id, arg_min(alias, place) AS alias FROM (VALUES {_ALIASES}) t(id, alias, place) GROUP BY id) a ON m.id = a.id"""
)
def models(spark, sf_dir):
    """Known embedding models by price, with the shortest of their short names."""
    return providers.models_table(spark)


@query("SELECT 'model-' || CAST(label AS VARCHAR) AS model, s AS chunk_lines, o AS overlap FROM (SELECT DISTINCT label FROM embeddings), (VALUES (30), (45), (60), (90), (120)) a(s), (VALUES (5), (10), (15), (20)) b(o) WHERE o < s")
def benchmark_grid(spark, sf_dir):
    """All settings of a benchmark, with the labels of the vectors as models."""
    names = table(spark, sf_dir, "embeddings").select("label").distinct().orderBy("label").collect()  # a label stands for a model
    return evaluate.grid(spark, [f"model-{r[0]}" for r in names])
