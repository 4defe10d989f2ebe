import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lakeseek.llm import mixing as M


def plain_copies(doc, mean, seed=7, part=16.0):
    parts = max(1, math.ceil(mean / part))
    n = 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        m = mean / parts
        p = c = math.exp(-m)
        k = 0
        while c <= u and k < 200:
            k += 1
            p = p * m / k
            c += p
            n += 1
    return n


@pytest.fixture
def docs(spark):
    rows = [(i, "x" * (10 + i % 50), f"s{0 if i % 3 == 0 else i % 11}", "keep") for i in range(600)]
    rows += [(1000, None, "s1", "k"), (1001, "", "empty", "k"), (None, "y" * 40, None, "k"), (7, "x" * 17, "s7", "k"), (1002, "tiny", "rare", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")


@pytest.mark.parametrize("options", [{}, {"alpha": 0.2, "epochs": 3.0}, {"targets": {"s1": 1.0, "rare": 1.0}}])
def test_matches_plain_version(docs, options):
    rates = {r.source: r.rate for r in M.source_rates(docs, **options).collect()}
    rows = [r.asDict() for r in docs.collect()]
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], c) for r in rows for c in range(plain_copies(r["doc_id"], rates[r["source"]])))
    out = M.mix_sources(docs, **options).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.copy) for r in out) == want
    assert sorted(r.position for r in out) == list(range(len(out)))
    key = lambda r: hashlib.md5(f"8:{'null' if r.doc_id is None else r.doc_id}:{r.copy}".encode()).hexdigest()
    ordered = sorted(out, key=lambda r: r.position)
    assert [key(r) for r in ordered] == sorted(map(key, out))
    if "targets" in options:
        assert {r.source for r in out} <= {"s1", "rare"} and max(rates.values()) > 16


def test_shares_follow_the_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w"), 20).alias("text"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    out = M.mix_sources(docs, {"small": 0.5, "large": 0.5}, position=False)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 10_000) < 400 and abs(n["large"] - 10_000) < 400 and out.columns == ["doc_id", "text", "source", "copy"]


def test_empty_tables(spark, docs):
    assert M.mix_sources(docs.limit(0)).count() == 0
    assert M.mix_sources(docs.where("source = 'empty'")).count() == 0


def test_many_sources_are_joined(spark, monkeypatch, docs):
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 2)
    a = sorted((r.doc_id or -1, r.copy, r.position) for r in M.mix_sources(docs).collect())
    monkeypatch.undo()
    assert a == sorted((r.doc_id or -1, r.copy, r.position) for r in M.mix_sources(docs).collect())


def test_other_columns_keep_their_names_and_values(spark):
    names = ["__key", "__n_copies", "__cdf", "__source", "__bucket", "a.b", "c0"]
    df = spark.createDataFrame([(i, "w" * 30, "s", *range(7), 9) for i in range(50)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names) + ", Copy int")
    for position in (True, False):
        out = M.mix_sources(df, position=position)
        assert out.columns == ["doc_id", "text", "source", *names, "copy", "position"][: None if position else -1]
        rows = out.collect()
        assert rows and all(r[3:10] == tuple(range(7)) and r[10] < 9 for r in rows)
