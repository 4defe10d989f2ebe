import numpy as np
import pytest

from lakeseek.llm import pq_dedup as Q


def brute(rows, cosine):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[k] = (label, x / np.linalg.norm(x))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    low = {}
    for k, (i, *_) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return [(i, links[k], low[find(k)], low[find(k)] == i) for k, (i, *_) in enumerate(rows)]


def vectors(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 100
    for c in range(25):
        base = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 30))):
            v = base + rng.normal(size=dim) * np.linalg.norm(base) * rng.choice([0.0, 0.02, 0.04, 0.06])
            rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1.0, 3.0])], int(c % 4)))
            i += 1
    for _ in range(60):
        rows.append((i, [float(np.float32(x)) for x in rng.normal(size=dim)], 1))
        i += 1
    rows += [(1, None, 1), (2, [], 1), (3, [0.0] * dim, 1), (4, [float("nan")] + [1.0] * (dim - 1), 1), (5, [None] + [1.0] * (dim - 1), 1), (6, [float("inf")] * dim, 1)]
    rows += [(7, rows[0][1], None), (8, rows[0][1][:8], 0), (9, rows[0][1], rows[0][2]), (9, rows[0][1], rows[0][2]), (10, [1.0] + [-0.0] * (dim - 1), 2), (11, [2.0] + [0.0] * (dim - 1), 2)]
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"lists": 12}), (3, {"lists": 5, "block": 16}), (4, {"lists": 1, "block": 7}), (5, {"sample": 40, "lists": 8})])
def test_all_links_are_found(spark, seed, options):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in Q.embedding_links(df, 0.98, **options).collect())
    assert got == sorted(brute(rows, 0.98))
    assert sum(r[1] for r in got) > 500


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert Q.embedding_links(df).count() == 0
    one = spark.createDataFrame([(1, None, 1, 9), (None, [1.0, 0.0], 1, 9)], "vec_id long, embedding array<float>, label int, n_links int")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in Q.embedding_links(one).collect()) == [(0, 0, None, False), (1, 0, 1, True)]


def test_double_vectors_are_compared_in_double(spark):
    a, b = [1.0, 1e-9, 0.0, 2.0], [1.0, 0.2, 0.0, 2.0]
    edge = np.arccos(0.98)
    near, far = ([float(np.cos(edge + e)), float(np.sin(edge + e)), 0.0, 0.0] for e in (-1e-12, 1e-12))
    rows = [(1, [x * 1e39 for x in a], 1), (2, [x * 1e39 for x in a], 1), (3, [x * 1e300 for x in b], 1), (4, [x * 1e-300 for x in b], 1)]
    rows += [(10, [1.0, 0.0, 0.0, 0.0], 2), (11, near, 2), (12, [1.0, 0.0, 0.0, 0.0], 3), (13, far, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in Q.embedding_links(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 10: (1, 10), 11: (1, 10), 12: (0, 12), 13: (0, 13)}
