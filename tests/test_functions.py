import datetime

import pytest
from pyspark.sql import functions as F

from lakeseek.functions import paths as P
from lakeseek.functions import scores as S
from lakeseek.functions import text as T
from lakeseek.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\u2029i", "\n", "x\n\n"])
def test_lines_are_splitlines(spark, text):
    assert one(spark, T.lines(F.lit(text))) == text.splitlines()


@pytest.mark.parametrize("text", ["", "  a b \t\n", "\x1c\u00a0a\u2003", "\x1fa\x1f", " \n "])
def test_strip_is_pythons(spark, text):
    assert one(spark, T.strip(F.lit(text))) == text.strip()


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Café foo_bar-BAZ x1 .. Ünï"))) == ["cafe", "foo", "bar", "baz", "x1", "uni"]
    assert T.phrases("hello foo.bar !!! Café") == [["hello"], ["foo", "bar"], ["cafe"]]
    assert T.phrases('say "x') == [] and T.phrases("!!!") == []


def test_hashes_and_keys(spark):
    import hashlib

    assert one(spark, T.content_hash(F.lit("a\r\nb"))) == hashlib.sha256(b"a\nb").hexdigest()
    assert one(spark, T.cache_key(F.lit("q"), F.lit(None), F.lit(3))) == hashlib.sha256(b"q|None|3").hexdigest()
    assert one(spark, T.decode_utf8(F.lit(bytearray(b"ok \xff\xfe.")))) == "ok ."


@pytest.mark.parametrize(
    "path,pattern,hit",
    [
        ("src/a/b.py", "src/*", True), ("src/a/b.py", "*.py", True), ("a.pyc", "*.py", False), ("a1.py", "a[0-9].py", True), ("ab.py", "a[!0-9].py", True), ("a1.py", "a[!0-9].py", False),
        ("src/x/y/z.py", "src/**/z.py", True), ("src/z.py", "src/**/z.py", True), ("src/x/yz.py", "**/y?.py", True), ("src/x/y/z.py", "src/**/*/q.py", False), ("A.PY", "*.py", False),
        ("a+b.py", "a+b.py", True), ("/abs/dir/f.go", "abs/*", True), ("x/[1].py", "**/[1].py", True),
    ],
)
def test_search_globs(spark, path, pattern, hit):
    assert one(spark, P.matches_any(F.lit(path), [pattern])) is hit


def test_excludes_match_below_any_directory(spark):
    got = {p: one(spark, P.excluded(F.lit(p), P.DEFAULT_EXCLUDES)) for p in ("a/vendor/b.py", "vendor/b.py", "a.md", "x/.env.local", "src/main.py", "a/Makefile")}
    assert got == {"a/vendor/b.py": True, "vendor/b.py": True, "a.md": True, "x/.env.local": True, "src/main.py": False, "a/Makefile": True}


@pytest.mark.parametrize("path,language", [("a/b.py", "python"), ("X.TS", "typescript"), ("a.R", "r"), ("a.S", "assembly"), ("Makefile", None), (".bashrc", None), ("a.tar.sh", "shell"), ("a.unknown", None)])
def test_language(spark, path, language):
    assert one(spark, P.language(F.lit(path))) == language


def test_references_sizes_and_review(spark):
    assert P.chunk_ref("42") == (None, 42) and P.chunk_ref("src/a.py:2") == ("src/a.py", 2) and P.chunk_ref("src/a.py") == ("src/a.py", None)
    assert [one(spark, P.size_text(F.lit(n))) for n in (0, 1023, 1024, 1536, 2 * 1048576)] == ["0B", "1023B", "1.0KB", "1.5KB", "2.0MB"]
    assert one(spark, P.review_reason(F.lit("a/app.LOG"), F.lit(5))) == "extension '.log'"
    assert one(spark, P.review_reason(F.lit("a/app_log.py"), F.lit(5))) == "filename suggests log/backup"
    assert one(spark, P.review_reason(F.lit("a/notes"), F.lit(600 * 1024))) == "large file (600.0KB) without code extension"
    assert one(spark, P.review_reason(F.lit("a/main.py"), F.lit(600 * 1024))) is None


@pytest.mark.parametrize("mime,text", [("text/x-c", True), ("image/svg", False), ("application/json", True), ("application/pdf", False), ("application/strange", False), ("inode/x-empty", True)])
def test_mime(spark, mime, text):
    assert one(spark, P.is_text_mime(F.lit(mime))) is text


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(-1.0))
    assert one(spark, V.dot(a, b)) == -1.0 and one(spark, V.norm(a)) == 5.0
    assert one(spark, V.normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.hash_embedding(F.lit("abc")))[0] == 0xBA / 255
    with pytest.raises(Exception, match="different lengths"):
        one(spark, V.dot(a, F.array(F.lit(1.0))))


def test_fusion_and_scaling(spark):
    assert one(spark, S.rrf(F.lit(1), F.lit(None))) == 1 / 61
    assert one(spark, S.rrf(F.lit(1), F.lit(2), k=10)) == 1 / 11 + 1 / 12
    assert one(spark, S.rrf(F.lit(None), F.lit(None))) == 0.0
    assert one(spark, S.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0.0
    assert one(spark, S.alpha_fusion(F.lit(0.5), F.lit(None))) == pytest.approx(0.35)


def plain_level(score, top, rank):
    band = "strong" if score >= 0.5 else "expected_range" if score >= 0.35 else "weak" if score >= 0.25 else "very_weak"
    if top <= 0:
        return "very_low"
    pct = score / top * 100
    if pct >= 90:
        return {"strong": "high", "expected_range": "high", "weak": "medium"}.get(band, "medium" if rank == 1 else "low")
    if pct >= 75 or band == "expected_range":
        return "medium"
    return "low" if pct >= 50 or band == "weak" else "very_low"


def test_hybrid_levels_over_a_grid(spark):
    rows = [(s / 20, t / 20, r) for s in range(-2, 21) for t in (-1, 0, 1, 5, 7, 10, 20) for r in (1, 2) if s <= t or t <= 0]
    df = spark.createDataFrame(rows, "s double, t double, r int").select("s", "t", "r", S.hybrid_level(F.col("s"), F.col("t"), F.col("r")).alias("x"))
    assert all(x.x == plain_level(x.s, x.t, x.r) for x in df.collect())


def test_signals(spark):
    got = [one(spark, S.signal(F.lit(a), F.lit(b), F.lit(r))) for a, b, r in ((0.6, 0.6, 1), (0.1, 0.1, 1), (0.58, 0.6, 2), (0.48, 0.6, 3), (0.08, 0.1, 2), (0.35, 0.6, 3), (0.1, 0.6, 4), (0.1, 0.0, 1))]
    assert got == [
        "top_result_strong_match", "top_result_very_weak_but_best_available", "close_to_top", "good_alternative", "close_to_top_but_weak_absolute", "moderate_relevance",
        "score_drop_from_top", "no_valid_top_score",
    ]


def test_times(spark):
    from lakeseek.sources.store import parse_time

    at = lambda s: one(spark, parse_time(s))
    assert at("2024-05-01T10:00:00Z") == at("2024-05-01 10:00") == at("2024-05-01T12:00:00+02:00") == datetime.datetime(2024, 5, 1, 10, 0)
    assert at("2024-05-01") == datetime.datetime(2024, 5, 1) and at("nonsense") is None
