import numpy as np
import pytest

from lakeseek.llm import line_dedup as L


def plain_units(text):
    raw = text.encode()
    return L.Units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


def test_units_are_the_same_in_pieces_and_in_other_lines(monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(500)]
    texts = ["\n".join(" ".join(rng.choice(words, int(rng.integers(0, 40)))) + rng.choice(["", "  ", "."]) for _ in range(60)) for _ in range(5)] + ["", " \n "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = L.Units(data, offsets)
    monkeypatch.setattr(L, "PIECE", 700)
    parts = L.Units(data, offsets)
    for name in ("doc", "number", "start", "end", "words", "h1", "h2"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name
    for d, t in enumerate(texts):  # units tile each text from its first word on
        at = whole.doc == d
        if at.any():
            assert whole.end[at][-1] == offsets[d + 1] and (whole.end[at][:-1] == whole.start[at][1:]).all()
    passage = " ".join(rng.choice(words, 60))
    a, b = (" ".join(rng.choice(words, 30)) for _ in range(2))
    x, y = ({tuple(h) for h in zip(u.h1, u.h2)} for u in (plain_units(f"{a} {passage} {b}"), plain_units(f"{b}, {passage.upper()} {a}")))
    assert len(x & y) >= 4


def brute(texts, ids, min_words, line_words):
    """Removed spans by dictionaries over the same units."""
    first, out = {}, []
    units = [plain_units(t or "") for t in texts]
    for i in sorted(range(len(texts)), key=lambda i: (ids[i], i)):
        for n, key in enumerate(zip(units[i].h1, units[i].h2)):
            if units[i].words[n]:
                first.setdefault(key, (ids[i], texts[i], n))
    for i, u in enumerate(units):
        flags = np.array([bool(w) and first[k] != (ids[i], texts[i], n) for n, (k, w) in enumerate(zip(zip(u.h1, u.h2), u.words))], bool)
        spans, n = [], 0
        while n < len(flags):
            if not flags[n]:
                n += 1
                continue
            m = last = n
            while m < len(flags) and (flags[m] or not u.words[m]):
                last = m if flags[m] else last
                m += 1
            if u.words[n : last + 1].sum() >= min_words:
                spans.append((int(u.start[n]), int(u.end[last])))
            else:
                for line in sorted(set(u.line[n : last + 1])):
                    own = np.nonzero(u.line == line)[0]
                    if own[0] >= n and own[-1] <= last and u.words[own].sum() >= line_words:
                        spans.append((int(u.start[own[0]]), int(u.end[own[-1]])))
            n = m
        out.append(spans)
    return out


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 400])
def test_matches_brute_force(spark, bucket_bytes):
    rng = np.random.default_rng(4)
    vocab = [f"word{i}" for i in range(3000)]
    make = lambda n: " ".join(rng.choice(vocab, n))
    passage, line, short = make(70), make(9), "Les."
    texts = [None, "", "...", make(50), f"{line}\n{make(30)}\n{short}", f"{make(20)} {passage} {make(20)}", f"{passage}\n{line}\n{short}", f"{make(10)} {passage.upper()}, {make(5)}\n- {line}!\n{short}"]
    texts += [texts[3], texts[5] + "\n" + make(8)]
    rows = [(i, t, f"x{i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    got = {r.doc_id: r for r in L.dedup_lines(df, bucket_bytes=bucket_bytes).collect()}
    want = brute(texts, list(range(len(texts))), 16, 6)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert [(s.start, s.end) for s in got[i].removed_spans] == want[i]
        at, left = 0, b""
        for s, e in want[i]:
            left += raw[at:s]
            at = e
        assert got[i].text.encode() == left + raw[at:] and got[i].n_bytes == len(raw)
    assert got[8].text == "" and passage[80:300] not in got[6].text and got[3].text == texts[3]
    assert short in got[7].text and line not in got[7].text


def test_repeats_nulls_and_empty_tables(spark):
    long = " ".join(f"n{i}" for i in range(40))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (None, None), (0, long)], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in L.dedup_lines(df).collect())
    assert got == [(-1, ""), (-1, ""), (0, long), (1, ""), (1, "")]
    assert L.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 60])
def test_short_and_unspaced_lines(spark, bucket_bytes):
    chinese = "这是一个没有空格的句子它在许多文件中重复出现"
    texts = [
        f"All rights reserved.\nfirst text here\n{chinese}\n- Menu -\nand then it ends there with Les.",
        f"second text is this\nALL rights   reserved\nLes.\n{chinese}\nMenu\n***",
        "All rights reserved. Not so!\nLes\nLes.\nMenu\nlast",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df, bucket_bytes=bucket_bytes, short_lines=True).collect()}
    assert got[0] == texts[0]
    assert got[1].split("\n") == ["second text is this", "Les.", "***"]
    assert got[2].split("\n") == ["All rights reserved. Not so!", "last"]
    got = {r.doc_id: r.text for r in L.dedup_lines(df, bucket_bytes=bucket_bytes).collect()}
    assert chinese in got[0] and chinese not in got[1] and "Les" in got[2]


def test_other_columns_keep_their_names_and_values(spark):
    long = " ".join(f"n{i}" for i in range(40))
    names = ["__units", "units", "key", "__key", "__id", "__crc", "a.b", "Removed_Units"]
    df = spark.createDataFrame([(1, long, *range(8)), (2, long, *range(8))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", *names[:7], "text", "removed_spans", "removed_units", "n_bytes"]
    assert sorted((r[0], r[1:8], r.text) for r in out.collect()) == [(1, tuple(range(7)), long), (2, tuple(range(7)), "")]
