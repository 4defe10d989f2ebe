import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeseek.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_score_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    width = Q.WORDS + Q.SHAPES + Q.STATS
    m = Q.FactorisationMachine(0.3, rng.normal(0, 0.1, width), rng.normal(0, 0.1, (width, Q.RANK)), rng.normal(0, 1, Q.STATS), np.ones(Q.STATS))
    index, value, stats = Q.features("Some words, and Some MORE words!! 123 | ***")
    x = np.zeros(width)
    x[index] = value
    x[Q.WORDS + Q.SHAPES :] = np.clip(stats - m.mean, -4, 4)
    at = np.nonzero(x)[0]
    pairs = sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for a, i in enumerate(at) for j in at[:a])
    assert m.score(index, value, stats) == pytest.approx(1 / (1 + np.exp(-(0.3 + m.w @ x + pairs))))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit_quality(docs, labels)
    rows = Q.score_quality(docs, model).withColumn("held_out", Q.held_out()).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and np.mean([(r.score >= 0.5) == r.quality for r in held]) >= 0.97
    kept = Q.keep_quality(docs, model)
    assert kept.columns == docs.columns and 0.6 * docs.count() < kept.count() < docs.count()
    again = Q.fit_quality(docs, labels.where(~Q.held_out()))
    assert np.array_equal(again.w, model.w) and np.array_equal(again.v, model.v)


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("src0"), "n_chars": F.lit(1).cast("long")})
    a, b = Q.fit_quality(docs, labels, 200), Q.fit_quality(moved, other, 200)
    assert np.array_equal(a.v, b.v) and a.bias == b.bias


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "text"), (4, "x" * 200_000), (4, "x" * 200_000), (5, "word " * 60_000), (6, "\n\n\t")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (4, 1), (5, 1), (5, 0), (99, 1)], "doc_id long, quality int")
    model = Q.fit_quality(docs, labels)
    out = Q.score_quality(docs, model).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    none = Q.fit_quality(docs, labels.limit(0))
    assert all(r.score == pytest.approx(1, abs=1e-5) for r in Q.score_quality(docs, none).collect())
    assert Q.score_quality(docs.limit(0), none).count() == 0 and Q.keep_quality(docs.limit(0), none).count() == 0


def test_repeated_ids_are_bounded_and_fixed(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(120), spark.read.parquet(f"{SF}/labels.parquet")
    more = docs.withColumn("text", F.concat("text", F.lit(" more")))
    a, b = (Q.fit_quality(x.repartition(n), labels, 40) for x, n in ((docs.union(more), 2), (more.union(docs), 5)))
    assert np.array_equal(a.v, b.v) and a.bias == b.bias
