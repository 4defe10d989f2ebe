import numpy as np
import pytest
import xxhash

from lakeseek.llm import simhash as S


def brute(texts, size):
    out = []
    for t in texts:
        w = []
        word = b""
        for ch in (t or "").encode():
            if ch in b"\x20\x09\x0a\x0b\x0c\x0d":
                if word:
                    w.append(word)
                word = b""
            else:
                word += bytes([ch + 32 if 65 <= ch <= 90 else ch])
        if word:
            w.append(word)
        sh = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        out.append(sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def roots(prints, budget):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}é" for i in range(300)]
    texts = [None, "", "  \n", "One", "one", "ONE two\x0bthree", "x" * 30000, "a b " * 4000]
    for _ in range(60):
        base = list(rng.choice(vocab, 200))
        texts.append(" ".join(base))
        for _ in range(3):
            base[rng.integers(200)] = "changed"
            texts.append("\n".join(base))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    for split in (50_000, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(df, 4, 4, split=split).collect()}
        want = brute(texts, 4)
        assert {i: f"{p:016x}" for i, p in enumerate(want)} == {i: v[0] for i, v in got.items()}
        assert roots(want, 4) == [got[i][1] for i in range(len(texts))]


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (9, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in S.simhash_components(df, 4, 4).collect())
    assert got == [(0, 7), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert S.simhash_components(df.limit(0), 4, 4).count() == 0
    assert sorted((r.doc_id or 0) for r in S.drop_near_duplicates(df).collect()) == [0, 7, 8]


def test_trie_on_random_prints():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)), base ^ np.uint64(0x1111), base ^ np.uint64(0x11111)]))
    got = S.trie_forest(prints, np.array([0]), np.array([len(prints)]), 4)
    assert got.tolist() == roots([int(x) for x in prints], 4)


@pytest.mark.parametrize("changed,together", [(3, True), (150, False)])
def test_similarity_classes(spark, changed, together):
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in rng.integers(0, 5000, 400)]
    other = list(words)
    for i in range(changed):
        other[(i * 400 // changed) % 400] = f"z{i}"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "something else entirely " * 20)], "doc_id long, text string")
    got = {r.doc_id: r.component for r in S.near_duplicate_classes(df).collect()}
    assert (got[2] == 1) is together and got[3] == 3


def jaccard(a, b):
    x, y = (set(S.shingle_set(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_similarity_is_decided_exactly(spark):
    rng = np.random.default_rng(5)
    texts, want = [], {}
    for shared, most in [(4, 5), (8, 10), (60, 75), (240, 300), (47, 60), (236, 300), (79, 100)] * 12:
        a, b = [], []  # sets of `most` shingles together, `shared` of them in both
        words = [f"v{x}" for x in rng.integers(0, 10**9, shared + 4)]
        a, b = " ".join(words), " ".join([*words, *(f"u{x}" for x in rng.integers(0, 10**9, most - shared))])
        want[len(texts)] = shared / most >= 0.8
        assert jaccard(a, b) == shared / most
        texts += [a, b]
    line = "one line that is here again and again "
    base = " ".join(f"k{i}" for i in range(200))
    want[len(texts)] = True  # a repeated line is one set of shingles
    texts += [f"{base} {line * 2}", f"{base} {line * 60}"]
    for split in (20_000, 1):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component for r in S.near_duplicate_classes(df, split=split).collect()}
        assert {i: got[i + 1] == i for i in want} == want and all(got[i] == i for i in want)


def test_exact_forest_against_all_pairs():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(60):
        core = rng.choice(4000, 40, replace=False)
        sets += [np.unique(np.concatenate([rng.permutation(core)[: int(rng.integers(30, 41))], np.arange(5000, 5020), rng.integers(0, 4000, 4)])) for _ in range(4)]
    flat, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert S.exact_forest(flat, offsets, 0.8).tolist() == root and len(set(root)) < len(sets)


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """Prints 0, 0xf, 0xff and 0x1ff form a chain that a row without an id is part of."""
    marks = {"a": 0, "b": 0xF, "c": 0xFF, "d": 0x1FF, "e": 0xFFFF << 40}
    df = spark.createDataFrame([(5, "a"), (None, "b"), (9, "c"), (None, "d"), (None, "e"), (3, "e")], "doc_id long, text string")
    monkeypatch.setattr(S, "fingerprints", lambda docs, size: spark.createDataFrame([(r.doc_id, marks[r.text]) for r in docs.collect()], "doc_id long, print long"))
    got = sorted(((r.doc_id or 0, r.fingerprint[-2:], r.component_id) for r in S.simhash_components(df).collect()))
    assert got == [(0, "00", 3), (0, "0f", 5), (0, "ff", 5), (3, "00", 3), (5, "00", 5), (9, "ff", 5)]


def test_texts_of_one_id_are_told_apart(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "Seven Eight nine ten eleven twelve")
    rows = [(3, b, 1), (5, b, 2), (5, a, 3), (5, a, None), (5, a, 2), (7, c, 1), (7, "", 1), (None, a, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(((r.doc_id or 0, r.text, r.n) for r in S.drop_near_duplicates(df).collect()))
    assert got == [(0, a, 1), (3, b, 1), (5, a, 2), (7, "", 1)]
    one = spark.createDataFrame([(3, b), (3, c), (3, b)], "doc_id long, text string")
    assert len(S.drop_near_duplicates(one).collect()) == 1


@pytest.mark.parametrize("shared,most", [(160, 200), (200, 250), (330, 400)])
def test_recall_at_the_threshold(spark, shared, most):
    """Pairs of a similarity of 0.80 to 0.825 are all found."""
    rng = np.random.default_rng(shared)
    texts = []
    for _ in range(100):
        words = [f"v{x}" for x in rng.integers(0, 10**9, shared + 4)]
        texts += [" ".join(words), " ".join([*words, *(f"u{x}" for x in rng.integers(0, 10**9, most - shared))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in S.near_duplicate_classes(df).collect()}
    assert all(got[i] == i - i % 2 for i in got)


@pytest.mark.parametrize("split", [5, 40])
def test_hot_groups_against_all_pairs(spark, split):
    """Chains and clouds of near copies that share most min-hash keys, with texts that share a passage only."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(40):  # a cloud of copies with changes at few places
        own = list(base)
        for i in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            own[i] = f"x{k}_{i}"
        texts.append(" ".join(own))
    own = list(base)
    for k in range(60):  # a chain: each is near the one before it, the ends are far apart
        own[(k * 2) % 120] = f"c{k}"
        texts.append(" ".join(own))
    texts += [" ".join([*base[:70], *(f"u{k}_{i}" for i in range(30))]) for k in range(20)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    sets = [S.shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # one row of a min-hash a key: all texts that share a passage meet
    got = {r.doc_id: r.component for r in S.near_duplicate_classes(df, bands=24, rows=1, split=split).collect()}
    assert [got[i] for i in range(len(texts))] == root and 5 < len(set(root)) < 60


def test_trie_with_leading_bits_against_all_pairs():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = lambda n, k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, k)).astype(np.uint64), axis=1)
    key = np.unique(np.concatenate([base, *(b ^ flips(25, int(rng.integers(1, 14))) for b in base)]))
    rest = rng.integers(0, 2, len(key)).astype(np.uint64)
    cut = len(key) // 3
    got = S.trie_forest(key, np.array([0, cut]), np.array([cut, len(key)]), 9, (20, 2), lambda i, j: rest[i] == rest[j])
    want = list(range(len(key)))
    for i in range(len(key)):
        for j in range(i):
            x = int(key[i] ^ key[j])
            if (i < cut) == (j < cut) and x.bit_count() <= 9 and (x >> 44).bit_count() <= 2 and rest[i] == rest[j] and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if r == high else r for r in want]
    assert got.tolist() == want and 20 < len(set(want)) < len(key) - 20


@pytest.mark.parametrize("group", [50_000, 8])
def test_proposals_of_tries(spark, group):
    """A crowd of near copies and pairs of 0.8 are proposed, strangers are not, and links do not grow with the crowd's square."""
    rng = np.random.default_rng(10)
    core = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.concatenate([np.delete(core, rng.integers(0, 200, 5)), rng.integers(0, 1 << 63, 5, dtype=np.uint64)]) for _ in range(150)]
    for _ in range(50):
        pair = rng.integers(0, 1 << 63, 250, dtype=np.uint64)
        sets += [pair[:200], pair]
    rows = [(i, S.wide_print(x, 10).view(np.int64).tolist()) for i, x in enumerate(sets)] + [(-1, [])]
    prints = spark.createDataFrame(rows, "node long, prints array<long>")
    links = [(r.a, r.b) for r in S.proposed_links(prints, 0.8, 32, 2, group, 4).collect()]
    root = list(range(len(sets)))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    assert root == [0] * 150 + [i - i % 2 for i in range(150, 250)]
    assert len(links) < 1000


def test_near_duplicates_come_from_the_tries(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in S.drop_near_duplicates(df).collect()] == [1]
    monkeypatch.setattr(S, "proposed_links", lambda sets, *_: sets.select("node", "node").toDF("a", "b").limit(0))
    assert sorted(r.doc_id for r in S.drop_near_duplicates(df).collect()) == [1, 2]  # equal sets are one before
