import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lakeseek.engine import Engine
from lakeseek.operators import cache, chunking, evaluate, fulltext, listing, providers, search
from lakeseek.sources import tree


def plain_windows(text, size, overlap):
    own, out, i, k = text.splitlines(), [], 0, 0
    while i < len(own):
        end = min(i + size, len(own))
        body = "\n".join(own[i:end]).strip()
        if body:
            out.append((k, i + 1, end, body))
            k += 1
        if end == len(own):
            break
        i = max(end - overlap, i + 1)
    return out


@pytest.mark.parametrize("size,overlap", [(10, 5), (20, 10), (3, 0), (3, 7), (1, 1), (120, 20)])
def test_line_windows(spark, size, overlap):
    texts = ["", "a", "\n\n\n", "\n".join(f"line {i}" for i in range(57)), "a\n\n\n\n\n\n\nb\r\n c \n", "x\n" * 121]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in chunking.chunk_lines(df, size=size, overlap=overlap).collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.start_line, r.end_line, r.text))
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, t in enumerate(texts) if (w := plain_windows(t, size, overlap))}


def test_syntax_chunks():
    code = "import os\n\n@dec\ndef a():\n    return 1\n\n# note\n\nclass B:\n    def m(self):\n        pass\nX = 1\n"
    got = [(c["start_line"], c["end_line"], c["text"].split("\n")[0]) for c in chunking.chunk_syntax_text(code, "p/x.py")]
    assert got == [(1, 2, "import os"), (3, 5, "@dec"), (9, 11, "class B:"), (12, 12, "X = 1")]
    assert chunking.chunk_syntax_text("def broken(:\n  x", "x.py")[0]["start_line"] == 1
    long = "def f():\n" + "    x = 1\n" * 200
    parts = chunking.chunk_syntax_text(long, "x.py", most=150, overlap=10)
    assert [(p["start_line"], p["end_line"]) for p in parts] == [(1, 150), (141, 201)]


def fts_rows(rows, query):
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x)")
    con.executemany("insert into t(rowid, x) values (?, ?)", rows)
    match = " ".join('"' + w.replace('"', '""') + '"' for w in query.split())
    return dict(con.execute("select rowid, -bm25(t) from t where t match ?", (match,)).fetchall())


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "foo_bar", "foo-bar alpha", "café", "missing"])
def test_bm25_is_the_full_text_engines(spark, query):
    rows = [(i, " ".join(w for j, w in enumerate(["alpha", "beta", "foo bar", "foo_bar", "Café", "gamma delta", "alpha alpha"]) if (i >> j) & 1) or "empty") for i in range(1, 100)]
    df = spark.createDataFrame(rows, "id long, text string")
    want = fts_rows(rows, query)
    for got in (fulltext.bm25(df, "id", query), fulltext.bm25_from_postings(fulltext.postings(df, "id"), fulltext.document_lengths(df, "id"), "id", query)):
        assert {r.id: pytest.approx(r.bm25, abs=1e-9) for r in got.collect()} == want


@pytest.fixture
def repo(tmp_path):
    files = {
        "src/auth.py": "def authenticate_user(name, password):\n    return check_credentials(name, password)\n\n\ndef check_credentials(name, password):\n    return True\n",
        "src/db.py": "def connect_database(url):\n    return url\n\n\ndef execute_query(sql):\n    return sql\n",
        "src/__init__.py": "VALUE = 1\n", "_dir/x.py": "W = 2\n", ".hidden.py": "H = 3\n", "README.md": "no\n", "empty.py": "", "node_modules/m.py": "no = 1\n",
    }
    for name, text in files.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "repo" / "bin.py").write_bytes(b"\0\1\2\xff")
    (tmp_path / "repo" / "bad.py").write_bytes(b"ok = 1 \xff\xfe\n")
    os.symlink(tmp_path / "repo" / "src" / "db.py", tmp_path / "repo" / "src" / "z_db.py")
    return str(tmp_path / "repo")


def test_scan(spark, repo):
    got = {r.path: r.reason for r in tree.indexable(tree.scan(spark, repo)).select("path", "reason").collect()}
    assert got == {"src/auth.py": None, "src/db.py": None, "src/__init__.py": None, "_dir/x.py": None, ".hidden.py": None, "bin.py": "binary", "bad.py": None}
    assert "README.md" in {r.path for r in tree.scan(spark, repo, include=["*.md"]).collect()}
    assert tree.add_ignored(repo, ["a", "b", "a"]) == ["a", "b"] and tree.add_ignored(repo, ["b", "c"]) == ["c"] and tree.ignore_patterns(repo) == ["a", "b", "c"]


def test_life_of_an_index(spark, repo, tmp_path):
    engine = Engine(spark, repo, str(tmp_path / "index"))
    first = engine.index(size=30, overlap=5)
    assert (first["indexed"], first["embedded"]) == (6, 6)
    again = engine.index(size=30, overlap=5)
    assert again["indexed"] == 0 and engine.store.version == 1
    with open(os.path.join(repo, "src", "copy.py"), "w") as f:
        f.write(open(os.path.join(repo, "src", "db.py")).read())
    third = engine.index(size=30, overlap=5)
    assert (third["indexed"], third["reused_global"], third["embedded"]) == (1, 1, 0)
    hits = engine.query("authenticate_user", search.Options(top_k=3))
    rows = engine.results(hits).collect()
    assert rows[0].path == "src/auth.py" and engine.fulltext_used and [r.rank for r in rows] == [1, 2, 3]
    assert engine.query("authenticate_user", search.Options(mode="fulltext")).count() == 1
    only = engine.query("def", search.Options(top_k=5, mode="semantic", include=("*/db.py",))).select("path", "rank").collect()
    assert [tuple(r) for r in only] == [("src/db.py", 1)]
    rer = engine.query("execute query", search.Options(top_k=2, mode="semantic", rerank="overlap")).collect()
    assert {r.path for r in rer} <= {"src/db.py", "src/copy.py"} and len(rer) == 2
    assert {r.path for r in search.summarise(hits).collect()} == {r.path for r in rows}
    assert engine.chunk("src/auth.py:0").first().start_line == 1
    engine.query("authenticate_user", search.Options(top_k=3)).count()
    levels = {r.level: (r.hits, r.misses) for r in engine.cache_report().collect()}
    assert levels["L1"][0] >= 1 and levels["L1"][1] >= 1
    assert engine.store.delete(["src/copy.py"], dry_run=True)["files"] == 1
    assert engine.store.delete(["src/copy.py"]) == {"files": 1, "chunks": 1}
    os.remove(os.path.join(repo, "src", "copy.py"))
    os.remove(os.path.join(repo, "bad.py"))
    assert engine.clean()["files"] == 1
    assert all(r.ok for r in engine.store.health().collect())
    page = engine.store.history_page(limit=2)
    assert page["total"] == 4 and page["has_more"] and page["entries"][0]["action"] == "clean"
    with pytest.raises(search.SearchError) as e:
        engine.query(" x ")
    assert e.value.code == "QUERY_TOO_SHORT"
    with pytest.raises(ValueError, match="MODEL_MISMATCH"):
        engine.index(model="small")
    assert engine.store.reset()["files"] == 5 and engine.store.status()["files"] == 0


def test_stream(spark, repo, tmp_path):
    from lakeseek.sources.store import Store
    from lakeseek.streaming.refresh import refresh_stream

    store = Store(spark, str(tmp_path / "index"))
    for want, extra in ((6, None), (7, "_late.py")):
        if extra:
            with open(os.path.join(repo, extra), "w") as f:
                f.write("late = True\n")
        refresh_stream(spark, repo, store, str(tmp_path / "checkpoint")).awaitTermination()
        assert store.status()["files"] == want


def test_dimension_checks(spark):
    mixed = spark.createDataFrame([([1.0] * 3,), ([1.0] * 2,)], "embedding array<float>")
    with pytest.raises(search.SearchError, match="mixes"):
        search.check_dimensions(mixed, 3)
    with pytest.raises(search.SearchError, match="2 dimensions"):
        search.check_dimensions(mixed.limit(1), 2)
    with pytest.raises(search.SearchError, match="empty"):
        search.check_dimensions(mixed.limit(0), 2)


def test_fusion_ranks_all_rows(spark):
    rows = [(i, "alpha" if i % 3 == 0 else "beta", "b", [float(100 - i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, branch string, embedding array<float>")
    hits, used = search.search(df, "alpha", [1.0, 0.0], options=search.Options(top_k=5))
    ranks = {i: i + 1 for i in range(60)}
    full = {i: k + 1 for k, i in enumerate([i for i in range(60) if i % 3 == 0][:20])}
    want = sorted(((round(1 / (60 + ranks[i]) + (1 / (60 + full[i]) if i in full else 0), 9), -i) for i in range(60)), reverse=True)[:5]
    assert used and [(r.score, -r.id) for r in hits.collect()] == want


def test_ranks_of_all_rows(spark):
    rows = [(i, float((i * 37) % 101) if i % 5 else 7.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, score double")
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    for parts in (1, 4, 64):
        assert {r.id: r["rank"] for r in search.rank_all(df, "id", parts=parts).collect()} == want
    assert search.rank_all(df.limit(0), "id").count() == 0


def test_filters_and_counts(spark):
    hits = spark.createDataFrame([("/src/app.py", 1), ("/tests/test_app.py", 2), ("/src/x.css", 3), ("/src/y.css", 4)], "path string, rank long")
    kept = search.path_filter(hits, ("*.py",), ("tests/*",))
    assert [r.path for r in kept.collect()] == ["/src/app.py"]
    s = search.filter_stats(hits, kept).first()
    assert (s.candidates_before, s.candidates_after, s.removal_pct) == (4, 1, 75.0) and "75%" in s.warning
    assert search.candidates_wanted(10, 50) == 50 and search.candidates_wanted(10) == 10 and search.candidates_wanted(30, 50, True) == 90


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id int, rank int")
    m = evaluate.metrics(ranks).first()
    assert (m.n, m.hit_at_1, m.hit_at_3, m.hit_at_5) == (3, 1, 1, 2) and m.mrr == pytest.approx((1 + 0.25) / 3)
    new = spark.createDataFrame([(1, 2), (2, 1), (3, 5)], "query_id int, rank int")
    s = evaluate.lift_summary(evaluate.lift(ranks, new)).first()
    assert tuple(s) == (2, 0, 1, 2)
    res = spark.createDataFrame([("q", "a/b.py", 1), ("q", "c.py", 2)], "query_id string, path string, rank int")
    truth = spark.createDataFrame([("q", "c.py"), ("z", "d.py")], "query_id string, expected string")
    assert {r.query_id: r.rank for r in evaluate.first_ranks(res, truth).collect()} == {"q": 2, "z": None}


def test_caches(spark):
    ev = spark.createDataFrame([("L1", "hit", 350), ("L1", "miss", None), ("L2", "miss", None), ("L3", "evict", None)], "level string, event string, time_saved_ms long")
    got = {r.level: tuple(r)[1:] for r in cache.report(ev.withColumn("timestamp", F.current_timestamp())).collect()}
    assert got == {"L1": (1, 1, 50.0, 350), "L2": (0, 1, 0.0, 0), "L3": (0, 0, 0.0, 0), "total": (1, 2, pytest.approx(100 / 3), 350)}


def test_token_batches():
    texts = ["x" * 30, "y" * 30, "z" * 3000, "w" * 30, ""]
    assert list(providers.token_batches(texts, 100, 2)) == [[0, 1], [2], [3, 4]]
    assert [i for b in providers.token_batches(texts, 10**6, 10) for i in b] == list(range(5))


def test_models():
    assert providers.resolve_model("voyage") == "voyage-code-3" and providers.resolve_dimensions("small") is None and providers.resolve_dimensions("voyage-3-lite") == 512
    with pytest.raises(ValueError):
        providers.resolve_dimensions("text-embedding-ada-002", 100)


def test_listing_differences(spark):
    a = spark.createDataFrame([("a", "m", 1, 1, "x"), ("b", "m", 1, 1, "y"), ("c", "m", 2, 1, "z")], "path string, branch string, mtime_ns long, size long, sha256 string")
    b = spark.createDataFrame([("a", "m", 1, 1, "x"), ("c", "m", 1, 1, "z"), ("d", "m", 1, 1, "q")], a.schema)
    assert {r.path: r.state for r in listing.differences(a, b).collect()} == {"a": "unchanged", "b": "added", "c": "modified", "d": "removed"}
    assert {r.path for r in listing.changed(a, b).collect()} == {"b", "c"} and {r.path for r in listing.changed(a, b, True).collect()} == {"b"}


def test_library_imports_without_corpus_operators(tmp_path):
    """The rest works when the optional subpackage and the pipeline are gone."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "lakeseek"), tmp_path / "lakeseek", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf' in q and 'pipeline' not in q and not any(x.startswith('op1') for x in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0


def test_windowed_counts_of_a_stream(spark, tmp_path):
    """Late rows count until the watermark passes; closed windows come out once."""
    import datetime

    from lakeseek.streaming.refresh import event_counts

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "ts timestamp, kind string"
    for k, rows in enumerate([[(at(1), "a"), (at(2), "a"), (at(7), "b")], [(at(3), "a"), (at(20), "b")], [(at(4), "a"), (at(40), "b")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = event_counts(stream, "ts", "5 minutes", "10 minutes", "kind").writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start.minute, r.kind): r.n for r in spark.sql("select * from counts").collect()}
    assert got[0, "a"] >= 3 and got[5, "b"] == 1 and (40, "b") not in got


def test_syntax_chunks_hold_the_whole_texts(spark):
    """The query against a plain version over whole texts: parsed and long units, and line windows for the rest."""
    from collections import defaultdict

    from lakeseek.operators.chunking import split_unit
    from lakeseek.plans import catalog

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = defaultdict(list)
    for r in sorted(catalog.queries()["syntax_chunks"](spark, sf).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        got[r.doc_id].append((r.start_line, r.end_line, r.text))
    split = windows = 0
    for i, t in texts.items():
        if i % 4 == 3:
            windows += 1
            assert got[i] == [(a, b, x.strip()) for a, b, x in split_unit(["def broken(:", *t.splitlines()], 1, 60, 10) if x.strip()]
            continue
        lines = ["def f(x):", '    """', *t.replace("\\", "/").replace("\0", " ").replace('"', "'").splitlines(), '"""', "    return x"]
        lines = lines if t else [*lines[:2], "", *lines[2:]]
        own = "\n".join(lines).split("\n")
        want = [(a, b, x.strip()) for a, b, x in (split_unit(own, 3, 150, 10) if len(own) > 150 else [(3, len(own) + 2, "\n".join(own))])]
        split += len(want) > 1
        assert got[i][1 : 1 + len(want)] == want and len(got[i]) == len(want) + 3, i
    assert windows > 10 and len(got) == len(texts), (windows, split)


def listing_of(spark, texts, time=1):
    rows = [(p, len(t), time, t.encode()) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, size long, mtime_ns long, content binary")


def folder_files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names if n.endswith(".parquet") and "/work/" not in d}


def test_a_change_rewrites_nothing(spark, tmp_path):
    from lakeseek.sources.store import Store

    store = Store(spark, str(tmp_path / "index"))
    texts = {f"f{i}.py": f"alpha{i} beta gamma\nshared words\n" for i in range(20)}
    store.index(listing_of(spark, texts))
    before = folder_files(tmp_path)
    texts["f3.py"] = "delta words\n"
    del texts["f4.py"]
    assert {k: v for k, v in store.index(listing_of(spark, texts)).items() if k in ("indexed", "removed", "chunks")} == {"indexed": 1, "removed": 1, "chunks": 1}
    assert store.delete(["f5.py"]) == {"files": 1, "chunks": 1}
    after = folder_files(tmp_path)
    assert before.items() <= after.items()
    del texts["f5.py"]
    assert {r.path: r.text for r in store.chunks().collect()} == {p: t.strip() for p, t in texts.items()}
    assert store.status()["files"] == 18 and store.version == 3 and all(r.ok for r in store.health().collect())
    hits = lambda q: {r.id: pytest.approx(r.bm25, abs=1e-12) for r in store.bm25(q).collect()}
    scanned = lambda q: {r.id: r.bm25 for r in fulltext.bm25(store.chunks(), "id", q).collect()}
    queries = ["words", "beta gamma", "beta-gamma", "alpha3", "delta", "shared-words beta", "missing", '"']
    for q in queries:
        assert scanned(q) == hits(q)
    assert "In(term" in store.bm25("beta gamma")._jdf.queryExecution().executedPlan().toString()
    want = {q: scanned(q) for q in queries}
    store.compact()
    assert store.rebuild_full_text()["chunks"] == 18
    assert all(hits(q) == want[q] for q in queries) and len(store.manifest()["segments"]) == 1
    assert not [p for p in before.keys() & folder_files(tmp_path).keys() if "/seg=" in p]  # two merges on, the first segments are gone


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    from lakeseek.sources import store as module

    monkeypatch.setattr(module, "MOST_SEGMENTS", 2)
    store = module.Store(spark, str(tmp_path / "index"))
    for i in range(4):
        store.index(listing_of(spark, {f"f{k}.py": f"word{k}\n" for k in range(i + 1)}))
    assert len(store.manifest()["segments"]) <= 2 and store.status()["files"] == 4 and store.bm25("word0").count() == 1


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    from lakeseek.sources.store import Store

    store = Store(spark, str(tmp_path / "index"))
    store.index(listing_of(spark, {"a.py": "one\n"}))
    state = lambda: (store.version, sorted(r.text for r in store.chunks().collect()), store.bm25("two").count())
    was = state()

    def dies(self, m):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # all is written, and no manifest names it
        m.setattr(Store, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            store.index(listing_of(spark, {"a.py": "two\n", "b.py": "two\n"}, 2))
    assert state() == was == (1, ["one"], 0)
    number = store._manifests()[0] + 1
    (tmp_path / "index" / "manifests" / f"{number:012}.new").write_text("{}")  # between the two steps
    (tmp_path / "index" / "manifests" / f"{number:012}.json").write_text('{"version": 9, "seg')  # cut off
    assert state() == was
    assert store.index(listing_of(spark, {"a.py": "two\n", "b.py": "two\n"}, 2))["indexed"] == 2
    assert state() == (2, ["two", "two"], 2)


def test_stream_batches_index_their_own_files(spark, repo, tmp_path, monkeypatch):
    from lakeseek.sources.store import Store
    from lakeseek.streaming import refresh

    store, seen = Store(spark, str(tmp_path / "index")), []
    index = Store.index
    monkeypatch.setattr(Store, "index", lambda self, listed, *a, **b: seen.append(sorted(r.path for r in listed.collect())) or index(self, listed, *a, **b))
    run = lambda: refresh.refresh_stream(spark, repo, store, str(tmp_path / "checkpoint")).awaitTermination()
    run()
    os.remove(os.path.join(repo, "bad.py"))
    with open(os.path.join(repo, "src", "db.py"), "a") as f:
        f.write("# more\n")
    old = tmp_path / "old.py"
    old.write_text("old = 1\n")
    os.utime(old, (1, 1))
    os.rename(old, os.path.join(repo, "old.py"))  # its own time is long past
    run()
    assert seen[1] == ["old.py", "src/db.py"] and len(seen) == 2
    assert sorted(r.path for r in store.files().collect()) == sorted([*(set(seen[0]) - {"bad.py"}), "old.py"])


def test_invalid_bytes_go_and_replacement_characters_stay(spark):
    from lakeseek.functions.text import decode_utf8

    raw = ["a�b".encode(), b"a\xff\xfeb", "﷐a﷐b�".encode() + b"\xe2\x82x", "é﷐".encode(), b"", None, "﷐".encode() + b"\xff" + b"b"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x binary").select("i", decode_utf8(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == [None if x is None else x.decode("utf-8", errors="ignore") for x in raw]


def test_documents_without_a_vector_take_part_in_full_text(spark):
    rows = [(i, "alpha" if i in (3, 50, 51) else "beta", "b", [float(100 - i), 1.0] if i < 50 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, branch string, embedding array<float>")
    for fusion in ("rrf", "alpha"):
        hits, used = search.search(df, "alpha", [1.0, 0.0], options=search.Options(top_k=60, fusion=fusion))
        assert used and {r.id for r in hits.collect()} == {*range(50), 50, 51}
    none, used = search.search(df.where("id >= 50"), "alpha", [1.0, 0.0], options=search.Options(top_k=5))
    assert used and [(r.id, r.score) for r in none.collect()] == [(50, round(1 / 61, 9)), (51, round(1 / 62, 9))]


@pytest.mark.parametrize("block,spread", [(2048, None), (7, 3)])
def test_batch_neighbours_against_brute_force(spark, block, spread):
    import numpy as np

    rng = np.random.default_rng(1)
    data = {i: rng.integers(-3, 4, 8).astype(float) for i in range(150)}
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in data.items()), (900, None), (901, []), (902, [1.0, 2.0])], "id long, embedding array<float>").repartition(3)
    got = search.knn_batch(df, "id", df.where("id % 10 = 0"), "id", 4, block=block, spread=spread).collect()
    want = [(q, i, float(data[q] @ data[i]), k + 1) for q in range(0, 150, 10) for k, i in enumerate(sorted(data, key=lambda i: (-float(data[q] @ data[i]), i))[:4])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert search.knn_batch(df, "id", df.limit(0), "id", 4).count() == 0
