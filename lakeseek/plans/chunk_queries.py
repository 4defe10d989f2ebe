"""Queries of chunkers, hashes, reuse and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import hash_embedding
from ..operators import chunking, evaluate, fulltext, listing, providers
from .catalog import query, table

LINES = "CASE WHEN text = '' OR text IS NULL THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def windows_sql(size: int, overlap: int, out: str = "doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, start_line, end_line, text") -> str:
    step = max(size - overlap, 1)
    return f"""
WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, 1 + greatest(0, CAST(ceil((len(ls) - {size}) / {step}) AS BIGINT)))) AS k FROM l WHERE len(ls) > 0),
c AS (SELECT doc_id, k, CAST(k * {step} + 1 AS INTEGER) AS start_line, CAST(least(k * {step} + {size}, len(ls)) AS INTEGER) AS end_line,
  trim(array_to_string(ls[k * {step} + 1 : k * {step} + {size}], chr(10)), {WHITE}) AS text FROM w),
chunks AS (SELECT * FROM c WHERE text <> '')
SELECT {out} FROM chunks"""


def chunks(spark, sf_dir, size=60, overlap=10):
    return chunking.chunk_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), size=size, overlap=overlap)


@query(windows_sql(60, 10))
def chunk_windows(spark, sf_dir):
    return chunks(spark, sf_dir)


@query(windows_sql(5, 1))
def chunk_windows_small(spark, sf_dir):
    return chunks(spark, sf_dir, 5, 1)


@query(windows_sql(3, 7))
def chunk_overlap_ge_size(spark, sf_dir):
    """An overlap beyond the size still moves on by a line."""
    return chunks(spark, sf_dir, 3, 7)


@query(windows_sql(30, 15, "count(*) AS total_chunks, count(DISTINCT sha256(text)) AS unique_hashes, count(*) - count(DISTINCT sha256(text)) AS duplicated, (count(*) - count(DISTINCT sha256(text))) * 100.0::DOUBLE / count(*) AS dedup_ratio"))
def chunk_hash_dedup_stats(spark, sf_dir):
    return listing.dedup_stats(chunks(spark, sf_dir, 30, 15).select(T.content_hash(F.col("text")).alias("text_sha256")))


_CLASS = windows_sql(10, 2, "doc_id, chunk_index, CASE WHEN g.h IS NULL THEN 'new' WHEN g.a <> doc_id OR g.b <> doc_id THEN 'global' ELSE 'local' END AS origin")
_CLASS = _CLASS.replace(
    "FROM chunks",
    """FROM (SELECT n.doc_id, CAST(row_number() OVER (PARTITION BY n.doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, sha256(text) AS h FROM chunks n) x
LEFT JOIN (SELECT sha256(c.text) AS h, min(c.doc_id) AS a, max(c.doc_id) AS b FROM chunks c JOIN documents d ON c.doc_id = d.doc_id
  WHERE d.source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') GROUP BY 1) g ON x.h = g.h""",
)


@query(_CLASS)
def chunk_reuse_classify(spark, sf_dir):
    """Where each chunk's vector comes from, with the chunks of ten sources as what is indexed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    new = chunking.chunk_lines(docs, size=10, overlap=2).withColumn("text_sha256", T.content_hash(F.col("text"))).withColumn("path", F.col("doc_id"))
    old = new.where(F.col("source").isin([f"src{i}" for i in range(10)])).withColumns({"model": F.lit("m"), "embedding": F.array(F.lit(0.0))})
    return listing.reuse(new.drop("text"), old, "m").select("doc_id", "chunk_index", "origin")


@query(windows_sql(10, 2, "sha256(text) AS text_sha256, count(DISTINCT doc_id) AS files, count(*) AS copies") + " GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def crossfile_duplicate_chunks(spark, sf_dir):
    own = chunks(spark, sf_dir, 10, 2).select("doc_id", T.content_hash(F.col("text")).alias("text_sha256"))
    return own.groupBy("text_sha256").agg(F.count_distinct("doc_id").alias("files"), F.count("*").alias("copies")).where("files > 1")


TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}\\p{Co}]+'), lambda t: t <> '')"


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def token_vocab(spark, sf_dir):
    return fulltext.vocabulary(table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM t GROUP BY term, doc_id")
def inverted_index(spark, sf_dir):
    return fulltext.postings(table(spark, sf_dir, "documents"), "doc_id").select("term", "doc_id", "tf")


@query(
    f"""SELECT count(*) AS documents, CAST(sum(len({TOKENS})) AS BIGINT) AS tokens, round(avg(len({TOKENS})), 6) AS mean_tokens, CAST(sum(length(text)) AS BIGINT) AS characters,
CAST(sum(length(text)) // 7 AS BIGINT) AS token_estimate, CAST(sum(length(text)) // 7 // 5 AS BIGINT) AS unique_estimate FROM documents"""
)
def doc_length_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.size(T.tokens(F.col("text")))
    out = docs.agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("mean_tokens"), F.sum(F.length("text")).alias("characters"))
    return out.withColumn("token_estimate", F.expr("characters div 7")).withColumn("unique_estimate", F.expr("characters div 7 div 5"))


@query("SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    """SELECT doc_id, CAST(i AS INTEGER) AS i, round(CAST(('0x' || substr(h, CAST((i % 32) * 2 + 1 AS BIGINT), 2))::BIGINT AS DOUBLE) / 255, 9) AS x
FROM (SELECT doc_id, sha256(text) AS h FROM documents), range(0, 256) r(i)"""
)
def hash_embedding_values(spark, sf_dir):
    """The offline embedder's numbers for all documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(hash_embedding(F.col("text"))).alias("i", "x")).withColumn("x", F.round("x", 9))


@query(
    """SELECT item_id, sha256(concat_ws('|', text, 'hash-256', 'None')) AS cache_key, sha256(concat_ws('|', 'hybrid', CAST(item_id AS VARCHAR), 'None')) AS other_key FROM benchmark"""
)
def cache_key_hash(spark, sf_dir):
    missing = F.lit(None).cast("string")
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", T.cache_key(F.col("text"), F.lit("hash-256"), missing).alias("cache_key"), T.cache_key(F.lit("hybrid"), F.col("item_id"), missing).alias("other_key"))


@query(windows_sql(10, 2, "doc_id, sha256(array_to_string(list_sort(list(substr(sha256(text), 1, 16))), '|')) AS content_key") + " GROUP BY doc_id")
def content_set_hash(spark, sf_dir):
    """The order-free key of each document's chunks, made in the row: a list of candidates is bounded, a source is not."""
    own = chunking.line_windows(F.col("text"), 10, 2)
    keys = F.transform(own, lambda w: F.substring(T.content_hash(w["text"]), 1, 16))
    return table(spark, sf_dir, "documents").select("doc_id", keys.alias("k")).where("size(k) > 0").select("doc_id", T.set_hash(F.col("k")).alias("content_key"))


@query(
    f"""WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents), p AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
q AS (SELECT doc_id, i, line, regexp_extract(line, '^[ \\t]*(The\\w*)', 1) AS a, regexp_extract(line, '^[ \\t]*(And\\w*)', 1) AS b FROM p)
SELECT doc_id AS path, CAST(i AS BIGINT) AS line_number, trim(line, {WHITE}) AS line,
  'where is the ' || CASE WHEN a <> '' THEN 'noun ' || a ELSE 'joint ' || b END || ' defined' AS query FROM q WHERE a <> '' OR b <> ''"""
)
def significant_lines(spark, sf_dir):
    """The extractor of definitions, with patterns that fit the corpus."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return evaluate.significant_lines(docs, patterns=[(r"^[ \t]*(The\w*)", "noun"), (r"^[ \t]*(And\w*)", "joint")])


@query(
    """SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 280) || chr(10) || '[...truncated...]' ELSE text END AS text FROM documents"""
)
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_to_tokens(F.col("text"), 100).alias("text"))


#: token_batches: texts are batched within runs of so many ids, by this budget and count.
RUN, BUDGET, MOST = 64, 2000, 8


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id // {RUN} AS run, doc_id, row_number() OVER (PARTITION BY doc_id // {RUN} ORDER BY doc_id) AS i, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length(text) // 3) END AS n FROM documents),
w AS (SELECT run, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS batch, least(n, {int(BUDGET * 0.9)}) AS used, CAST(1 AS BIGINT) AS held, n > {int(BUDGET * 0.9)} AS alone FROM d WHERE i = 1
  UNION ALL SELECT d.run, d.i, w.batch + CAST(x AS BIGINT), CASE WHEN x THEN 0 ELSE used END + least(d.n, {int(BUDGET * 0.9)}), CASE WHEN x THEN 0 ELSE held END + 1, d.n > {int(BUDGET * 0.9)}
  FROM (SELECT w.*, d.n, alone OR d.n > {int(BUDGET * 0.9)} OR used + d.n > {int(BUDGET * 0.9)} OR held >= {MOST} AS x FROM w JOIN d ON d.run = w.run AND d.i = w.i + 1) w JOIN d ON d.run = w.run AND d.i = w.i + 1)
SELECT min(doc_id) AS first_doc, count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens FROM w JOIN d USING (run, i) GROUP BY run, batch"""
)
def token_batches(spark, sf_dir):
    """Greedy batches of the texts of each run of 64 ids, as a provider is sent them: (first doc, texts, tokens)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for rows in batch.column("rows").to_pylist():
                rows.sort(key=lambda r: r["doc_id"])
                for part in providers.token_batches([r["text"] or "" for r in rows], BUDGET, MOST):
                    out.append((rows[part[0]]["doc_id"], len(part), sum(max(1, len(t) // 3) if t else 0 for t in (rows[i]["text"] for i in part))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["first_doc", "texts", "tokens"])

    own = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / RUN).alias("run")).agg(F.collect_list(F.struct("doc_id", "text")).alias("rows"))  # RUN ids
    return own.select("rows").mapInArrow(run, "first_doc long, texts long, tokens long")


_BODY = "replace(replace(replace(coalesce(text, ''), chr(92), '/'), chr(0), ' '), chr(34), chr(39))"
_DOCSTRING = "chr(34) || chr(34) || chr(34)"


@query(
    f"""WITH src AS (SELECT doc_id, coalesce(text, '') AS text, string_split({_BODY}, chr(10)) AS body FROM documents),
f AS (SELECT doc_id, list_concat(list_concat(['def f(x):', '    ' || {_DOCSTRING}], body), [{_DOCSTRING}, '    return x']) AS ls FROM src WHERE doc_id % 4 <> 3),
b AS (SELECT doc_id, CASE WHEN text = '' THEN ['def broken(:'] WHEN text LIKE '%' || chr(10) THEN list_concat(['def broken(:'], string_split(text, chr(10))[:-2]) ELSE list_concat(['def broken(:'], string_split(text, chr(10))) END AS ls FROM src WHERE doc_id % 4 = 3),
u AS (SELECT doc_id, 3 AS first, ls, CASE WHEN len(ls) > 150 THEN 150 ELSE len(ls) END AS size, CASE WHEN len(ls) > 150 THEN 140 ELSE len(ls) END AS step FROM f UNION ALL SELECT doc_id, 1, ls, 60, 50 FROM b),
w AS (SELECT doc_id, first, ls, size, step, unnest(range(0, 1 + greatest(0, CAST(ceil((len(ls) - size) / step::DOUBLE) AS BIGINT)))) AS k FROM u),
c AS (SELECT doc_id, first + k * step AS start_line, first + least(k * step + size, len(ls)) - 1 AS end_line, trim(array_to_string(ls[k * step + 1 : k * step + size], chr(10)), {WHITE}) AS text FROM w
  UNION ALL SELECT doc_id, 1, 2, 'import os' FROM f
  UNION ALL SELECT doc_id, len(ls) + 4, len(ls) + 6, 'class A:' || chr(10) || '    def m(self):' || chr(10) || '        pass' FROM f
  UNION ALL SELECT doc_id, len(ls) + 7, len(ls) + 8, 'VALUE = 1' FROM f)
SELECT doc_id, 'a/' || CAST(doc_id AS VARCHAR) || '.py' AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS INTEGER) AS chunk_index, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, text FROM c WHERE text <> ''"""
)
def syntax_chunks(spark, sf_dir):
    """Syntax chunks of a file made from each whole text: a function with it as its docstring, or, of every fourth, code that
    does not parse.

    A backslash or a double quote inside a text becomes another character, so that the generated code parses; every fourth
    text follows a broken line, which leaves it to line windows.
    """
    docs = table(spark, sf_dir, "documents")
    body = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), '\\\0"', "/ '"), "\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    code = F.concat(F.lit('import os\n\ndef f(x):\n    """\n'), body, F.lit('\n"""\n    return x\n\nclass A:\n    def m(self):\n        pass\n\nVALUE = 1\n'))
    code = F.when(F.pmod("doc_id", F.lit(4)) == 3, F.concat(F.lit("def broken(:\n"), F.coalesce("text", F.lit("")))).otherwise(code)
    return chunking.chunk_syntax(docs.select("doc_id", F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), code.alias("text")))


_BYTES = "list_transform(range(0, 32), lambda i: CAST(('0x' || substr(text_sha256, CAST(i * 2 + 1 AS BIGINT), 2))::BIGINT AS DOUBLE) / 255)"


@query(
    "WITH h AS (" + windows_sql(60, 10, "DISTINCT sha256(text) AS text_sha256") + f"), b AS (SELECT text_sha256, {_BYTES} AS x FROM h)"
    " SELECT text_sha256, 256 AS dim, round(CAST(CAST(x[1] / sqrt(8 * list_sum(list_transform(x, lambda y: y * y))) AS FLOAT) AS DOUBLE), 5) AS x0 FROM b"
)
def embed_chunks(spark, sf_dir):
    """The embedding provider over all chunks, each distinct content once: (text_sha256, dim, first number)."""
    own = chunks(spark, sf_dir).withColumn("text_sha256", T.content_hash(F.col("text"))).groupBy("text_sha256").agg(F.min("text").alias("text"))
    return providers.embed(own).select("text_sha256", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 5).alias("x0"))
