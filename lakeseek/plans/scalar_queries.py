"""Queries of paths, globs, vectors, fusion and confidence expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scores as S
from ..functions import text as T
from ..functions.vectors import dot, norm, normalise
from ..operators import listing, search
from .catalog import query, table

PATH = "source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.txt'"
CODE = "source || '/' || lang || '/f' || CAST(doc_id AS VARCHAR) || CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' WHEN 2 THEN '.TS' WHEN 3 THEN '.log' WHEN 4 THEN '' WHEN 5 THEN '.R' ELSE '.txt' END"


def files(spark, sf_dir):
    """Documents as files: path, branch, size."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), F.col("source").alias("branch"), F.col("n_chars").alias("size"))


def code_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ends = F.create_map(*(x for i, e in enumerate([".py", ".min.js", ".TS", ".log", "", ".R", ".txt"]) for x in (F.lit(i), F.lit(e))))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 7).cast("int")))
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", name).alias("path"), "source", "lang", (F.col("n_chars") * 100).alias("size"))


@query(f"SELECT doc_id FROM documents WHERE {PATH} LIKE 'src1%/en/%' AND regexp_matches({PATH}, '^src1.*/en/.*3\\.txt$')")
def path_glob_include(spark, sf_dir):
    """A shell pattern whose stars cross slashes."""
    return search.path_filter(files(spark, sf_dir), ("src1*/en/*3.txt",)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({PATH}, '^(?:.*/)?en/doc_[^/]*7\\.txt$') OR regexp_matches({PATH}, '^src2/(?:.*/)?doc_1[^/]\\.txt$')")
def path_glob_recursive(spark, sf_dir):
    """Patterns with **, whose other stars stay within a directory."""
    return search.path_filter(files(spark, sf_dir), ("**/en/doc_*7.txt", "src2/**/doc_1?.txt")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT ({PATH} LIKE 'src3/%' OR regexp_matches({PATH}, '^.*doc_[0-4].*$'))")
def path_exclude(spark, sf_dir):
    return search.path_filter(files(spark, sf_dir), exclude=("src3/*", "*doc_[0-4]*")).select("doc_id")


@query(
    """SELECT count(*) AS candidates_before, CAST(count_if(lang = 'en') AS BIGINT) AS candidates_after, round((count(*) - count_if(lang = 'en')) * 100.0::DOUBLE / count(*), 1) AS removal_pct,
'fnmatch_postfilter' AS method, CASE WHEN round((count(*) - count_if(lang = 'en')) * 100.0::DOUBLE / count(*), 1) > 50
  THEN 'path filter removed ' || CAST(CAST(round(round((count(*) - count_if(lang = 'en')) * 100.0::DOUBLE / count(*), 1)) AS INTEGER) AS VARCHAR) || '% of candidates' END AS warning FROM documents"""
)
def path_filter_stats(spark, sf_dir):
    own = files(spark, sf_dir)
    return search.filter_stats(own, search.path_filter(own, ("*/en/*",)))


@query(f"SELECT doc_id FROM documents WHERE NOT (doc_id % 7 IN (1, 3, 6))")
def default_excludes(spark, sf_dir):
    """Files that the default patterns leave: .min.js, .log and .txt go."""
    own = code_files(spark, sf_dir)
    return own.where(~P.excluded(F.col("path"), P.DEFAULT_EXCLUDES)).select("doc_id")


@query(
    f"""SELECT page_id, split_part(url, '/', -1) AS name, array_to_string(string_split(url, '/')[-2:], '/') AS tail,
CASE WHEN lower(regexp_extract(split_part(url, '/', -1), '^\\.*[^.].*?(\\.[^.]+)$', 1)) IN ('.html', '.htm') THEN 'html' END AS language FROM pages"""
)
def url_language_map(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", P.basename(F.col("url")).alias("name"), P.last_two(F.col("url")).alias("tail"), P.language(F.col("url")).alias("language"))


@query(
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 5 THEN 'r' END AS language,
CASE doc_id % 7 WHEN 3 THEN 'extension ''.log''' WHEN 4 THEN CASE WHEN n_chars * 100 > 512000 THEN 'large file (' || CASE WHEN n_chars * 100 < 1048576 THEN printf('%.1fKB', n_chars * 100 / 1024.0::DOUBLE + 1e-9) ELSE printf('%.1fMB', n_chars * 100 / 1048576.0::DOUBLE + 1e-9) END || ') without code extension' END
  WHEN 6 THEN CASE WHEN n_chars * 100 > 512000 THEN 'large file (' || CASE WHEN n_chars * 100 < 1048576 THEN printf('%.1fKB', n_chars * 100 / 1024.0::DOUBLE + 1e-9) ELSE printf('%.1fMB', n_chars * 100 / 1048576.0::DOUBLE + 1e-9) END || ') without code extension' END END AS reason FROM documents"""
)
def review_flags(spark, sf_dir):
    own = code_files(spark, sf_dir)
    return own.select("doc_id", P.language(F.col("path")).alias("language"), P.review_reason(F.col("path"), F.col("size")).alias("reason"))


@query(
    """SELECT event_id, CASE WHEN event_id < 1024 THEN event_id || 'B' WHEN event_id < 1048576 THEN printf('%.1fKB', event_id / 1024.0::DOUBLE + 1e-9) ELSE printf('%.1fMB', event_id / 1048576.0::DOUBLE + 1e-9) END AS size,
CASE WHEN event_id >= 60000 THEN printf('%.1f min', event_id / 60000.0::DOUBLE + 1e-9) WHEN event_id >= 1000 THEN printf('%.1fs', event_id / 1000.0::DOUBLE + 1e-9) ELSE event_id || 'ms' END AS duration,
CASE WHEN event_id < 60 THEN 'just now' WHEN event_id < 3600 THEN event_id // 60 || 'm ago' WHEN event_id < 86400 THEN event_id // 3600 || 'h ago' ELSE event_id // 86400 || 'd ago' END AS age FROM events"""
)
def formatted_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select("event_id", P.size_text(i).alias("size"), P.duration_text(i).alias("duration"), P.age_text(i).alias("age"))


@query(
    """SELECT m AS mime, m IN ('text/plain', 'application/json', 'inode/x-empty') AS is_text, CASE WHEN m = '' THEN 'text' ELSE split_part(m, '/', 1) END AS category, count(*) AS n
FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/json' WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/zip' WHEN 4 THEN 'inode/x-empty' ELSE '' END AS m FROM documents) GROUP BY m"""
)
def mime_classes(spark, sf_dir):
    names = F.array(*map(F.lit, ["text/plain", "application/json", "image/png", "application/zip", "inode/x-empty", ""]))
    own = table(spark, sf_dir, "documents").select(F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("mime"))
    return own.groupBy("mime").agg(F.count("*").alias("n")).select("mime", P.is_text_mime(F.col("mime")).alias("is_text"), P.mime_category(F.col("mime")).alias("category"), "n")


@query(
    """SELECT substr(replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10), '\\n'), 1, 240) AS snippet, doc_id FROM documents"""
)
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self_dot,
round((embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS first_unit FROM embeddings"""
)
def vector_norms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.round(norm(v), 6).alias("norm"), F.round(dot(v, v), 6).alias("self_dot"), F.round(normalise(v)[0].cast("double"), 5).alias("first_unit"))


@query("SELECT CAST(len(embedding) AS BIGINT) AS dim, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, dim LIMIT 1")
def dim_mode(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))
    return own.orderBy(F.desc("n"), "dim").limit(1)


@query("SELECT count(DISTINCT d) AS dimensions, count(DISTINCT d) > 1 AS mixed FROM (SELECT len(CASE WHEN vec_id % 100 = 0 THEN embedding[1:32] ELSE embedding END) AS d FROM embeddings)")
def mixed_dim_check(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 100 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("v"))
    return own.agg(F.count_distinct(F.size("v")).alias("dimensions")).withColumn("mixed", F.col("dimensions") > 1)


_SCORES = """
s AS (SELECT e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank, max(score) OVER () AS top FROM s),
p AS (SELECT *, CASE WHEN top > 0 THEN score / top * 100 ELSE 0 END AS pct, CASE WHEN score >= 0.5 THEN 'strong' WHEN score >= 0.35 THEN 'expected_range' WHEN score >= 0.25 THEN 'weak' ELSE 'very_weak' END AS band FROM r),
c AS (SELECT *, CASE WHEN top <= 0 THEN 'very_low' WHEN pct >= 90 AND band IN ('strong', 'expected_range') THEN 'high' WHEN pct >= 90 AND band = 'weak' THEN 'medium'
    WHEN pct >= 90 THEN CASE WHEN rank = 1 THEN 'medium' ELSE 'low' END WHEN pct >= 75 OR band = 'expected_range' THEN 'medium' WHEN pct >= 50 OR band = 'weak' THEN 'low' ELSE 'very_low' END AS level,
  CASE WHEN top <= 0 THEN 'no_valid_top_score' WHEN rank = 1 THEN CASE band WHEN 'strong' THEN 'top_result_strong_match' WHEN 'expected_range' THEN 'top_result_in_typical_range' WHEN 'weak' THEN 'top_result_weak_absolute' ELSE 'top_result_very_weak_but_best_available' END
    WHEN pct >= 90 THEN 'close_to_top' WHEN pct >= 75 THEN CASE WHEN band IN ('strong', 'expected_range') THEN 'good_alternative' ELSE 'close_to_top_but_weak_absolute' END
    WHEN pct >= 50 THEN 'moderate_relevance' ELSE 'score_drop_from_top' END AS signal FROM p)"""


def scored(spark, sf_dir):
    """Cosines of all vectors with vector 0, ranked."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    return search.rank_all(search.semantic_scores(e, "vec_id", q), "vec_id")


@query(f"WITH {_SCORES} SELECT vec_id, score, rank, level AS confidence, round(pct, 1) + 0.0::DOUBLE AS relative_pct, band AS absolute_quality, signal FROM c")
def confidence_levels(spark, sf_dir):
    return search.with_confidence(scored(spark, sf_dir), cut=False).select("vec_id", "score", "rank", "confidence", "relative_pct", "absolute_quality", "signal")


@query(f"WITH {_SCORES} SELECT l.confidence, count(c.vec_id) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('very_low')) l(confidence) LEFT JOIN c ON c.level = l.confidence GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return search.histogram(search.with_confidence(scored(spark, sf_dir), cut=False))


@query(
    f"""WITH {_SCORES} SELECT vec_id, CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.3 THEN 'low' ELSE 'very_low' END AS absolute_level,
CASE WHEN top <= 0 THEN 'very_low' WHEN score / top >= 0.9 THEN 'high' WHEN score / top >= 0.75 THEN 'medium' WHEN score / top >= 0.5 THEN 'low' ELSE 'very_low' END AS relative_level FROM r"""
)
def confidence_absolute(spark, sf_dir):
    return search.with_top(scored(spark, sf_dir), "top").select("vec_id", S.absolute_level(F.col("score")).alias("absolute_level"), S.relative_level(F.col("score"), F.col("top")).alias("relative_level"))


@query(
    """WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, round(coalesce(1::DOUBLE / (60 + a), 0) + coalesce(CASE WHEN b % 3 <> 0 THEN 1::DOUBLE / (60 + b) END, 0), 9) AS rrf,
round(0.7::DOUBLE * (1::DOUBLE / a) + (1 - 0.7::DOUBLE) * coalesce(CASE WHEN b % 3 <> 0 THEN 1::DOUBLE / b END, 0), 9) AS alpha FROM r"""
)
def fusion_scores(spark, sf_dir):
    """Each user's events by value and by time, fused; a third has no second rank."""
    w = search.Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events")
    r = e.select("event_id", F.row_number().over(w.orderBy(F.desc("value"), "event_id")).alias("a"), F.row_number().over(w.orderBy("ts", "event_id")).alias("b0"))
    r = r.withColumn("b", F.when(F.col("b0") % 3 != 0, F.col("b0")))
    alpha = S.alpha_fusion(F.lit(1.0) / F.col("a"), F.lit(1.0) / F.col("b"))
    return r.select("event_id", F.round(S.rrf(F.col("a"), F.col("b")), 9).alias("rrf"), F.round(alpha, 9).alias("alpha"))


@query("SELECT label, vec_id, round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS scaled FROM (SELECT label, vec_id, embedding[1]::DOUBLE AS x, min(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS lo, max(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS hi FROM embeddings)")
def min_max_by_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"))
    w = search.Window.partitionBy("label")
    return e.select("label", "vec_id", F.round(S.min_max(F.col("x"), F.min("x").over(w), F.max("x").over(w)), 6).alias("scaled"))


@query(f"SELECT 'src' || CAST(doc_id % 20 AS VARCHAR) AS directory, 1 AS one FROM documents WHERE false")
def skipped_directories(spark, sf_dir):
    """Nothing lies in a directory that is never entered."""
    own = files(spark, sf_dir)
    return own.where(P.in_skipped_dir(F.col("path"))).select(F.col("branch").alias("directory"), F.lit(1).alias("one"))


@query(f"SELECT CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.log' WHEN 4 THEN '(none)' WHEN 5 THEN '.r' ELSE '.txt' END AS extension, count(*) AS files, CAST(sum(n_chars * 100) AS BIGINT) AS bytes, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM documents GROUP BY 1")
def listing_stats(spark, sf_dir):
    return listing.by_extension(code_files(spark, sf_dir))


@query("SELECT source || '/' || lang AS directory, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1 ORDER BY files DESC, directory LIMIT 10")
def top_dirs(spark, sf_dir):
    return listing.top_directories(files(spark, sf_dir))


@query(f"SELECT {PATH} AS path, n_chars AS size FROM documents ORDER BY size DESC, path LIMIT 5")
def largest_files(spark, sf_dir):
    return listing.largest(files(spark, sf_dir))


@query(f"SELECT doc_id, {PATH} AS path FROM documents WHERE {PATH} LIKE 'src1/%' OR regexp_matches('doc_' || doc_id || '.txt', '^doc_.5\\.txt$') OR {PATH} = 'src0/en/doc_20.txt'")
def delete_matches(spark, sf_dir):
    """What a delete of these patterns would take."""
    return listing.matching(files(spark, sf_dir), ["src1/*", "doc_?5.txt", "src0/en/doc_20.txt"]).select("doc_id", "path")
