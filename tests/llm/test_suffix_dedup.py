import hashlib
from collections import Counter

import numpy as np
import pytest

from lakeseek.llm import suffix_dedup as S


def brute(texts, width):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i + 1 : i + 1 + width] = True
        runs = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda n, k=4: "".join(rng.choice(list("abcdé")[:k], n))
    texts = [None, "", "a", "a" * 19, "a" * 20, "a" * 21, "a" * 300, "ab" * 100, "abc" * 70 + "x", "a" * 25]
    passages = [word(60) for _ in range(4)] + ["xy" * 18, "zzz" * 11]
    for _ in range(40):
        t = word(int(rng.integers(0, 120)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[rng.integers(len(passages))]
            i, j = sorted(rng.integers(0, len(p) + 1, 2))
            t += p[i:j] + word(int(rng.integers(0, 60)), 5)
        texts.append(t)
    for i in (11, 12, 13):
        texts += [texts[i], texts[i + 5] + word(3) + texts[i], texts[i][3:]]
    return texts


@pytest.mark.parametrize("seed,hot,cap", [(1, 64, 20_000), (2, 1, 20_000), (3, 64, 2), (4, 64, 20_000)])
def test_matches_brute_force(spark, seed, hot, cap):
    texts = corpus(seed)
    df = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    keyed = df.drop("doc_id").withColumnRenamed("spans", "doc_id")
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(keyed, width=20, gram=6, hot=hot, cap=cap, bucket_bytes=500, with_text=False).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 20)


def test_other_columns_nulls_and_empty_tables(spark):
    rows = [(1, "q" * 500, 1), (1, "q" * 500, 1), (None, "r" + "q" * 450, 2), (3, "s" * 399, 3), (4, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df).collect())
    assert got == {(1, 500, 500, 1, b""): 2, (None, 451, 450, 1, b"r"): 1, (3, 399, 0, 0, b"s" * 399): 1, (4, 0, 0, 0, b""): 1}
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefgh "), 9000))
    texts = [base, base[1000:1600] + "#", "#" + base[8000:], "".join(rng.choice(list("abcdefgh "), 5000)) + base[4000:4500]]
    monkeypatch.setattr(S, "PIECE", 1500)
    want = brute(texts, 400)
    parts = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        own = np.zeros(len(data), bool)
        for _, part, offsets, b in S._pieces(data, np.array([0, len(data)]), 400):
            a, n, *_ = S.fragments(part, offsets)
            for x, k in zip(a, n):
                assert not own[x + b : x + b + k].any()
                own[x + b : x + b + k] = True
        parts.append(own)
        assert own[: max(0, len(data) - 399)].all() and not own[max(0, len(data) - 399) :].any()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df, with_text=False).collect()}
    assert [got[i] for i in range(len(texts))] == want
