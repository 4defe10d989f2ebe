"""The opN_ queries themselves, by name, on whole tables of the smallest scale."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_line_dedup import brute as brute_lines
from test_line_dedup import plain_units
from test_pq_dedup import brute as brute_vectors
from test_simhash import brute as brute_prints
from test_simhash import roots

from lakeseek.llm import catalog, html_extract
from lakeseek.llm.media import encode_pgm, npy_bytes, read_npy

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(catalog.tokenizer_file())


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return catalog.queries()[name](spark, SF)


def test_names():
    assert sorted(catalog.queries(), key=lambda n: int(n[2:].split("_")[0])) == list(catalog.queries()) and len(catalog.queries()) == 10


def test_op1(spark, docs, tokenizer):
    out = run(spark, "op1_packing")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out.collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == docs.keys()
    for i, own in by_doc.items():
        ids, at = np.array([*tokenizer.encode(docs[i], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
        total, padding = total + at, padding + (2048 - at if at & (at - 1) else 0)
    assert padding <= 0.03 * total


def test_op3(spark, docs):
    for r in run(spark, "op3_media").collect():
        raw = docs[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        stored = npy_bytes(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert read_npy(stored).tobytes() == payload and encode_pgm(read_npy(stored)).endswith(payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want


def spans_of(text):
    return [tuple(map(int, s.split("-"))) for s in text.split(",") if s]


def without(raw, spans):
    left, at = b"", 0
    for a, b in spans:
        left, at = left + raw[at:a], b
    return left + raw[at:]


def test_op4(spark, docs):
    ids = sorted(docs)
    texts = [docs[i] for i in ids]
    first = {}
    for i, t in zip(ids, texts):
        for n, line in enumerate(lines_of(t)):
            first.setdefault(line, (i, n))
    passages = dict(zip(ids, brute_lines(texts, ids, 16, 6)))
    for r in run(spark, "op4_line_dedup").collect():
        raw, got = docs[r.doc_id].encode(), spans_of(r.spans)
        assert r.text.encode() == without(raw, got) and r.n_removed == sum(b - a for a, b in got) and r.n_spans == len(got) and r.n_bytes == len(raw)
        gone = np.zeros(len(raw) + 1, bool)
        for a, b in got:
            gone[a:b] = True
        assert all(gone[a:b].all() for a, b in passages[r.doc_id])
        kept = [k for n, k in enumerate(lines_of(docs[r.doc_id])) if k and first[k] != (r.doc_id, n)]
        left = Counter(lines_of(r.text))
        assert not [k for k in kept if left[k] and first[k][0] != r.doc_id], r.doc_id  # no later occurrence of a line is left


def lines_of(text):
    out = []
    for line in text.split("\n"):
        u = plain_units(line)
        out.append(tuple((int(a), int(b)) for a, b, w in zip(u.h1, u.h2, u.words) if w))
    return out


def test_op5(spark, docs):
    raws = {i: t.encode() for i, t in docs.items()}
    seen = Counter(hash(r[k : k + 400]) for r in raws.values() for k in range(len(r) - 399))
    removed = 0
    for r in run(spark, "op5_suffix_dedup").collect():
        raw = raws[r.doc_id]
        gone = np.zeros(len(raw) + 2, np.int8)
        for k in range(len(raw) - 399):
            if seen[hash(raw[k : k + 400])] > 1:
                gone[k + 1 : k + 401] = 1
        kept = bytes(np.frombuffer(raw, np.uint8)[gone[1:-1] == 0])
        edges = np.diff(gone)
        want = list(zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist()))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), len(want), hashlib.sha256(kept).hexdigest())
        assert spans_of(r.spans) == want and (r.text.encode() == kept or "�" in r.text)
        removed += r.n_removed
    assert removed > 10_000


def test_op6(spark, docs):
    rows = run(spark, "op6_quality").collect()
    assert {r.doc_id for r in rows} == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_op7(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, run(spark, "op7_embeddings").collect())) == sorted(brute_vectors(rows, 0.98))


def test_op8(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = run(spark, "op8_html").collect()
    assert len(rows) == len(pages) and all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == html_extract.extract(pages[r.page_id].html) for r in rows) >= 0.9 * len(rows)


def test_op9(spark, docs):
    ids = sorted(docs)
    prints = brute_prints([docs[i] for i in ids], 4)
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, roots(prints, 4))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op9_simhash").collect()} == want


@pytest.mark.parametrize("name", ["op2_mixing", "op10_licenses"])
def test_queries_with_sql(spark, name):
    import duckdb

    out = run(spark, name)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = con.execute(f"select {', '.join(out.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(rows) and rows
