import io
import json
import os

import pytest

from lakeseek import cli
from lakeseek.engine import Engine
from lakeseek.functions import paths as P
from lakeseek.operators import providers, search
from lakeseek.server import TOOLS, Server
from lakeseek.sources.store import save_settings, with_branch


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, text in {"a.py": "def alpha():\n    return 1\n", "lib/b.py": "class Beta:\n    pass\n\n\ndef gamma():\n    return 2\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def run(spark, *argv):
    return cli.run(cli.parser().parse_args(argv), spark)


def test_command_line(spark, repo, tmp_path, capsys):
    scope = ["--root", repo, "--db", str(tmp_path / "db")]
    assert run(spark, "index", *scope)[0]["indexed"] == 2
    rows = run(spark, "query", *scope, "gamma", "-n", "2")
    assert rows[0]["path"] == "lib/b.py" and {"chunk_ref", "score", "confidence", "language", "snippet"} <= rows[0].keys()
    assert run(spark, "query", *scope, "gamma", "--no-json")[0].startswith("lib/b.py:")
    assert run(spark, "query", *scope, "gamma", "--summarize", "--rerank", "--glob", "*.py")[0]["chunks_matched"] >= 1
    assert run(spark, "chunk", *scope, "a.py:0")[0]["text"].startswith("def alpha")
    assert run(spark, "status", *scope)[0]["files"] == 2 and all(r.get("ok", True) for r in run(spark, "health", *scope))
    assert run(spark, "index", *scope, "--list")[0]["extensions"][0]["extension"] == ".py"
    assert run(spark, "delete", *scope, "lib/*", "--save-ignore")[0] == {"files": 1, "chunks": 2, "ignored": ["lib/*"]}
    assert run(spark, "log", *scope)[0]["total"] == 2
    assert run(spark, "reindex", *scope, "--no-ast")[0]["indexed"] == 1
    assert run(spark, "clean", *scope)[0]["files"] == 0
    assert {r["level"] for r in run(spark, "cache-report", *scope)} == {"L1", "L2", "L3", "total"}
    assert run(spark, "reset", *scope, "--force")[0]["files"] == 1
    assert run(spark, "models")[0]["price"] == 0.0 and run(spark, "device")[0]["chunkers"]["python"]
    assert cli.main(["query", *scope, "x"]) == 1 and json.loads(capsys.readouterr().out)["error_code"] == "QUERY_TOO_SHORT"
    assert cli.main(["reset", *scope]) == 1


def test_tune(spark, repo, tmp_path):
    best = run(spark, "tune", "--root", repo, "--db", str(tmp_path / "db"), "--samples", "2", "--sizes", "30", "--save")
    assert best[0]["chunk_lines"] == 30 and 0 <= best[0]["accuracy"] <= 1
    assert "LAKESEEK_CHUNK_LINES=30" in open(os.path.join(repo, ".env")).read()


def test_tool_server(spark, repo, tmp_path):
    server = Server(Engine(spark, repo, str(tmp_path / "db")))
    call = lambda i, name, **a: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": a}})
    lines = [
        json.dumps({"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {}}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}),
        json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/list"}), call(2, "index"), call(3, "query", query="gamma", top_k=1), call(4, "query", query="g"), call(5, "status"), "not json",
    ]
    out = io.StringIO()
    server.serve(lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert {t["name"] for t in got[1]["result"]["tools"]} == set(TOOLS)
    text = lambda k: json.loads(got[k]["result"]["content"][0]["text"])
    assert text(2)["indexed"] == 2 and text(3)[0]["path"] == "lib/b.py" and text(4)["error_code"] == "QUERY_TOO_SHORT" and text(5)["files"] == 2
    assert got[6]["error"]["code"] == -32700


def test_caches_of_results(spark, repo, tmp_path):
    engine = Engine(spark, repo, str(tmp_path / "db"))
    engine.index()
    options = search.Options(top_k=2, rerank="overlap")
    first = [(r.id, r.score, r.confidence) for r in engine.query("alpha beta", options).collect()]
    again = [(r.id, r.score) for r in engine.query("alpha beta", options).collect()]
    assert [x[:2] for x in first] == again
    levels = {r.level: (r.hits, r.misses) for r in engine.cache_report().collect()}
    assert levels["L1"] == (1, 1) and levels["L2"] == (1, 1) and levels["L3"] == (1, 1)
    with open(os.path.join(repo, "new.py"), "w") as f:
        f.write("beta = 1\n")
    engine.index()
    engine.query("alpha beta", options).count()
    levels = {r.level: (r.hits, r.misses) for r in engine.cache_report().collect()}
    assert levels["L2"] == (1, 2) and engine.trim_cache() == {"L1": 0, "L2": 0, "L3": 0}


def test_options_from_the_environment():
    o = search.options_from_env({"LAKESEEK_SEARCH_MODE": "semantic", "LAKESEEK_RRF_K": "10", "LAKESEEK_CONF_STRONG": "0.9"}, top_k=3)
    assert (o.mode, o.rrf_k, o.thresholds.strong, o.top_k, o.thresholds.weak) == ("semantic", 10, 0.9, 3, 0.25)


def test_small_parts(spark, tmp_path):
    path = tmp_path / ".env"
    path.write_text("A=1\nB=2\n")
    save_settings(str(path), B=3, C=4)
    assert path.read_text() == "A=1\nB=3\nC=4\n"
    assert with_branch(spark.createDataFrame([(1,)], "id long")).first().branch == "default"
    assert P.is_simple_pattern("*.py") and not P.is_simple_pattern("a*b") and not P.is_simple_pattern("*.p?")
    n, took = providers.best_batch(providers.HashEmbedder(), ["a", "b"], (2, 4))
    assert n in (2, 4) and set(took) == {2, 4}
    hits = spark.createDataFrame([(1, "xx", 1), (2, "x", 2)], "id long, text string, rank long")
    providers.RERANKERS["length"] = providers.model_scorer("length", lambda q, ts: [-len(t) for t in ts])
    try:
        assert [r.id for r in providers.rerank(hits, "q", "length").orderBy("rank").collect()] == [2, 1]
    finally:
        del providers.RERANKERS["length"]


def test_reranking_families(monkeypatch):
    family = providers.rerank_family
    assert [family(n) for n in ("overlap", "minilm", "bge-m3", "some/model", "flashrank", "flashrank:tiny", "ms-marco-MiniLM-L-12-v2", "voyage", "voyage:2", "rerank-2.5")] == [
        "own", "cross-encoder", "cross-encoder", "cross-encoder", "flashrank", "flashrank", "flashrank", "voyage", "voyage", "voyage",
    ]
    assert len(providers.RERANK_ALIASES) == 8 and providers.rerank_problem("overlap") is None
    monkeypatch.delenv("VOYAGE_API_KEY", raising=False)
    assert "VOYAGE_API_KEY" in providers.rerank_problem("voyage:lite")
    monkeypatch.setenv("VOYAGE_API_KEY", "k")
    assert providers.rerank_problem("voyage") is None and all(providers.reranker(n) for n in providers.RERANK_ALIASES)


@pytest.fixture
def service():
    """A local stand-in for a re-ranking service: scores are text lengths, best first; it fails once before."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body["model"], body["query"]))
            self.send_response(503 if len(seen) == 1 else 200)
            self.end_headers()
            rows = [{"index": i, "relevance_score": len(t)} for i, t in enumerate(body["documents"])]
            self.wfile.write(json.dumps({"data": sorted(rows, key=lambda r: -r["relevance_score"])}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", seen
    server.shutdown()


def test_reranking_service(monkeypatch, service):
    url, seen = service
    monkeypatch.setenv("LAKESEEK_VOYAGE_URL", url)
    monkeypatch.setenv("VOYAGE_API_KEY", "k")
    assert providers._service_scores("rerank-2.5", "q", ["a", "ccc", "bb"]) == [1.0, 3.0, 2.0]
    assert seen[1:] == [("/v1/rerank", "Bearer k", "rerank-2.5", "q")]
    monkeypatch.setenv("LAKESEEK_VOYAGE_URL", "http://127.0.0.1:9")
    monkeypatch.setenv("LAKESEEK_VOYAGE_RETRIES", "0")
    with pytest.raises(OSError):
        providers._service_scores("rerank-2.5", "q", ["a"])


def test_results_survive_a_re_ranker_that_fails(spark, repo, tmp_path, monkeypatch, capsys):
    monkeypatch.delenv("VOYAGE_API_KEY", raising=False)
    engine = Engine(spark, repo, str(tmp_path / "db"))
    engine.index()
    plain = [r.id for r in engine.query("alpha beta", search.Options(top_k=2)).collect()]
    for cached in (True, False):
        hits = engine.query("alpha beta", search.Options(top_k=2, rerank="voyage"), cached=cached).collect()
        assert [r.id for r in hits] == plain and "VOYAGE_API_KEY" in engine.rerank_skipped

    def broken(query, texts):
        raise RuntimeError("no model")

    monkeypatch.setitem(providers.RERANKERS, "broken", providers.model_scorer("broken", broken))
    assert [r.id for r in engine.query("alpha beta", search.Options(top_k=2, rerank="broken")).collect()] == plain and "failed" in engine.rerank_skipped
    assert engine.query("alpha beta", search.Options(top_k=2, rerank="overlap")).count() == 2 and engine.rerank_skipped is None
    with pytest.raises(ValueError, match="VOYAGE_API_KEY"):
        providers.rerank(engine.query("alpha beta"), "q", "voyage")
    scope = ["--root", repo, "--db", str(tmp_path / "db")]
    assert run(spark, "query", *scope, "gamma", "--rerank", "--rerank-model", "voyage") and "not re-ranked" in capsys.readouterr().err
    assert all(r.get("ok", True) for r in run(spark, "health", *scope, "--rebuild"))


def test_cache_events_are_written_together(spark, repo, tmp_path, monkeypatch):
    from lakeseek import engine as module

    monkeypatch.setattr(module, "EVENTS", 3)
    engine = Engine(spark, repo, str(tmp_path / "db"))
    for i in range(14):
        engine._event("L1", "hit" if i % 2 else "miss", 350 if i % 2 else None)
    assert len(os.listdir(tmp_path / "db" / "cache" / "events")) < 14
    assert {r.level: (r.hits, r.misses) for r in engine.cache_report().collect()}["L1"] == (7, 7)


def test_usable_models(monkeypatch):
    for name in ("LAKESEEK_API_KEY", "LAKESEEK_BASE_URL", "VOYAGE_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert [m for m, why in providers.usable_models().items() if why is None] == ["hash-256"]
    monkeypatch.setenv("LAKESEEK_API_KEY", "k")
    assert providers.usable_models()["text-embedding-3-small"] is None and "VOYAGE" in providers.usable_models()["voyage-3"]
    assert providers.shortest_alias("text-embedding-3-small") == "small" and providers.shortest_alias("voyage-3") is None
