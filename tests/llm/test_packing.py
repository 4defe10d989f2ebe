import zlib
from collections import defaultdict

import numpy as np
import pytest

from lakeseek.llm import packing as P
from lakeseek.llm.catalog import tokenizer_file


def reference_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_file()).encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [None, "", "a", "Hello, wörld! <|endoftext|> it's 12,345 — ñandú\n\n\t  x", "日本語 🙂🙃 é ​\x00", " " * 3000, "ab" * 5000, "word " * 2047, "<|endoftext|>", "\r\n" * 50, "don't DON'T I'll", "x" * 70_000]


def test_ids_are_those_of_tokenizers():
    encode = P.encoder(tokenizer_file())
    for t in TEXTS:
        assert [*encode(t or "").tolist(), 1] == reference_ids(t)


@pytest.mark.parametrize("seq_len,grain", [(2048, 8), (64, 4)])
def test_pieces_tile_documents_and_sequences(spark, seq_len, grain):
    rng = np.random.default_rng(1)
    texts = TEXTS + [" ".join(f"w{x}" for x in rng.integers(0, 999, int(n))) for n in rng.exponential(300, 80)]
    rows = [(i if i != 4 else None, t, 0, "x") for i, t in enumerate(texts)] + [(20, texts[20], 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset long, payload string")
    out = P.pack_documents(df, tokenizer_file(), seq_len, grain, payload="ids").collect()
    assert all(r.length == len(r.payload) // 4 and 0 < r.length for r in out)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        want = np.array(reference_ids(t), "<u4").tobytes()
        own = sorted(by_doc[i if i != 4 else None], key=lambda r: (r.start, r.sequence_id))
        copies = 2 if i == 20 else 1
        assert sum(r.length for r in own) == copies * len(want) // 4 and all(r.doc_tokens == len(want) // 4 for r in own)
        for r in own:
            assert r.payload == want[4 * r.start : 4 * (r.start + r.length)]
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= seq_len
        total += at
        padding += 0 if at & (at - 1) == 0 else seq_len - at
    assert padding <= 0.03 * total
    crc = P.pack_documents(df, tokenizer_file(), seq_len, grain, payload="crc32").collect()
    key = lambda r: (r[0] if r[0] is not None else -1, *r[1:])
    assert sorted(map(key, map(tuple, crc))) == sorted(key((r.doc_id, r.start, r.length, zlib.crc32(r.payload), r.doc_tokens, r.sequence_id, r.offset)) for r in out)


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file()).count() == 0


def test_knapsack_and_program():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 20), 5, replace=False))
        values = rng.random(5)
        best = np.zeros(31)
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes, values) if s <= c)])
        got = P.knapsack(sizes, values, 30)
        assert got @ sizes <= 30 and got @ values == pytest.approx(best[30])
    # 44 rolls of 81, 3 of 70, 48 of 68 from rolls of 218: the classic optimum is 47 patterns or a little more
    patterns, x = P.solve_cutting_stock(np.array([68, 70, 81]), np.array([48.0, 3.0, 44.0]), 218)
    assert np.allclose(patterns @ x, [48, 3, 44]) and x.sum() >= (48 * 68 + 3 * 70 + 44 * 81) / 218 - 1e-9
    layout, planned = P.plan_layout({68: 48, 70: 3, 81: 44}, 218)
    assert sum(c for _, c in layout) <= np.ceil(x.sum()) + 2 and planned <= sum(c for _, c in layout)
    for cls, n in ((68, 48), (70, 3), (81, 44)):
        assert sum(p.get(cls, 0) * c for p, c in layout) == n
    assert all(sum(k * v for k, v in p.items()) <= 218 for p, _ in layout)


@pytest.mark.parametrize("text", ["<|endoftext|>a b", "a b<|endoftext|> c", "a b <|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext|", "<|<|endoftext|>|>", "é<|endoftext|>é\n"])
def test_literal_end_token_has_its_own_id(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_file()).encode(text, add_special_tokens=False).ids
    assert P.encoder(tokenizer_file())(text).tolist() == own
    assert own.count(50256) == text.count("<|endoftext|>")


def test_program_is_within_its_gap_of_the_optimum():
    sizes, capacity = np.array([3, 5, 7, 11]), 24
    every = np.array([p for p in np.ndindex(9, 5, 4, 3) if 0 < np.dot(p, sizes) <= capacity])
    rng = np.random.default_rng(5)
    for _ in range(10):
        demand = rng.integers(1, 10_000, 4).astype(float)
        exact = P.solve_cutting_stock(sizes, demand, capacity, gap=0)
        duals = np.linalg.solve(exact[0].T.astype(float), np.ones(4))
        bound = duals @ demand / (every @ duals).max()  # of the dual program over all patterns
        assert exact[1].sum() == pytest.approx(bound)
        patterns, x = P.solve_cutting_stock(sizes, demand, capacity)
        assert np.allclose(patterns @ x, demand) and x.sum() <= bound * (1 + 1.01e-4)
    with pytest.warns(UserWarning):
        P.solve_cutting_stock(np.array([68, 70, 81]), np.array([48.0, 3.0, 44.0]), 218, gap=0, max_columns=1)


def test_first_basis_is_a_solution():
    rng = np.random.default_rng(7)
    for m, capacity in ((1, 5), (5, 9), (60, 256), (256, 256)):
        sizes = np.sort(rng.choice(np.arange(1, capacity + 1), m, replace=False))
        demand = rng.integers(1, 1000, m)
        patterns, x, inverse = P.first_basis(sizes, demand, capacity)
        assert (x >= 0).all() and (sizes @ patterns <= capacity).all() and np.allclose(patterns @ x, demand)
        assert np.allclose(inverse @ patterns, np.eye(m), atol=1e-6)
