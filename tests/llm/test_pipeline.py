"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_line_dedup import brute as brute_lines
from test_mixing import plain_copies
from test_packing import reference_ids

import corpus_pipeline as C
from lakeseek.llm import mixing
from lakeseek.llm import quality as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base, out = tmp_path_factory.mktemp("steps"), [docs]
    for name, stage in C.STAGES:
        path = str(base / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(steps):
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "substrings", "mixing", "packing"]
    assert all(s.dtypes == steps[0].dtypes for s in steps[:5])


def test_quality(spark, steps):
    docs, labels = rows(steps[0]), {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{SF}/labels.parquet"))}
    known = sorted((d["doc_id"], d["text"]) for d in docs if d["doc_id"] in labels and zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1)
    model = Q.train([Q.features(t) for _, t in known], np.array([labels[i] for i, _ in known], float))
    want = sorted(d["doc_id"] for d in docs if model.score(*Q.features(d["text"])) >= 0.5)
    assert sorted(r["doc_id"] for r in rows(steps[1])) == want
    assert all(r in docs for r in rows(steps[1]))


def test_near_duplicates(steps):
    before, after = rows(steps[1]), rows(steps[2])
    sets = {}
    for r in before:
        w = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = {r["doc_id"] for r in after}
    assert len(after) == len(kept) < len(before) and all(r in before for r in after)
    assert not [(a, b) for a in kept for b in kept if a < b and jaccard(a, b) >= 0.8]
    assert all(any(b < a and jaccard(a, b) >= 0.5 for b in sets) for a in sets.keys() - kept)
    alone = [a for a in sets if all(a == b or jaccard(a, b) < 0.65 for b in sets)]
    assert set(alone) <= kept


def test_substrings(steps):
    before, after = sorted(rows(steps[2]), key=lambda r: r["doc_id"]), {r["doc_id"]: r for r in rows(steps[3])}
    spans = brute_lines([r["text"] for r in before], [r["doc_id"] for r in before], 16, 6)
    assert len(after) == len(before) and any(spans)
    for r, own in zip(before, spans):
        raw, at, left = r["text"].encode(), 0, b""
        for s, e in own:
            left += raw[at:s]
            at = e
        got = after[r["doc_id"]]
        assert got["text"].encode() == left + raw[at:] and got["n_chars"] == len(got["text"])
        assert (got["lang"], got["source"]) == (r["lang"], r["source"])


def test_mixing(steps):
    before, after = rows(steps[3]), rows(steps[4])
    rates = {r.source: r.rate for r in mixing.source_rates(steps[3]).collect()}
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += len(r["text"])
    total, weight = sum(sizes.values()), sum(v**0.7 for v in sizes.values() if v)
    assert all(rates[s] == pytest.approx(v**0.7 / weight * total / v, abs=1e-8) for s, v in sizes.items() if v)
    want = Counter({r["doc_id"]: plain_copies(r["doc_id"], rates[r["source"]]) for r in before})
    assert Counter(r["doc_id"] for r in after) == +want


def test_packing(steps):
    texts = {r["doc_id"]: r["text"] for r in rows(steps[4])}
    copies = Counter(r["doc_id"] for r in rows(steps[4]))
    by_doc, by_seq = defaultdict(Counter), defaultdict(list)
    for r in rows(steps[5]):
        by_doc[r["doc_id"]][r["start"], r["length"], r["ids_crc32"]] += 1
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = np.array(reference_ids(texts[doc]), "<u4")
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in pieces)
        assert sum(n * k for (_, n, _), k in pieces.items()) == copies[doc] * len(ids)
        covered = np.zeros(len(ids), int)
        for (s, n, _), k in pieces.items():
            covered[s : s + n] += k
        assert (covered == copies[doc]).all()
    fills = []
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        fills.append(at)
    assert max(fills) <= 2048 and sum(2048 - f for f in fills if f & (f - 1)) <= 0.03 * sum(fills)


def test_run_gives_the_same(spark, steps):
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows(C.run(spark, SF)))) == sorted(map(key, rows(steps[5])))


def test_empty_documents(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like the operators' own."""
    names = ["removed_spans", "removed_units", "copy", "position", "component", "payload", "prints", "units", "n_bytes", "score", "__units", "bands", "node"]
    long = " ".join(f"word{i}" for i in range(40_000))
    texts = [None, "", long, long + " more", "Short one.", "Short one.", "Les mots et les choses sont ici pour le moment.", None]
    data = [(None if i == 5 else i % 7, t, None if i == 4 else "en", None if i == 6 else "s1", None if i % 2 else 7, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(data, schema)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    before = {r["copy"]: r for r in rows(docs)}
    for name, stage in C.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.dtypes == docs.dtypes, name
            for r in rows(out):
                was = before[r["copy"]]
                assert all(r[c] == was[c] for c in docs.columns if c not in ("text", "n_chars")), name
        if name == "near_duplicates":
            assert sorted(r["position"] for r in rows(out)) == ["position0", "position2", "position4", "position5", "position6"]
        if name == "substrings":
            got = {r["position"]: r for r in rows(out)}
            assert len(got) == 8 and got["position2"]["text"] == long and len(got["position3"]["text"]) < 100
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        if name == "packing":
            assert {r["doc_id"] for r in rows(out)} == {None, 0, 1, 2, 3, 4, 6}
