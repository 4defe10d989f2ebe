"""A tool server on standard input and output: JSON-RPC lines with the tools query, chunk, index, status and health.

python -m lakeseek.server ROOT. The session stays up between calls, and a query brings the index up to date first.
"""

from __future__ import annotations

import json
import sys

from .engine import Engine
from .operators import listing, search
from .session import session
from .streaming.refresh import refresh_if_stale

_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
TOOLS = {
    "query": ("Ranked chunks for a question", {"query": _TEXT, "top_k": _NUMBER, "mode": _TEXT, "rerank": {"type": "boolean"}, "glob": {"type": "array", "items": _TEXT}, "summarize": {"type": "boolean"}}, ["query"]),
    "chunk": ("A chunk and its neighbours", {"ref": _TEXT, "before": _NUMBER, "after": _NUMBER}, ["ref"]),
    "index": ("Bring the index up to date", {"chunk_lines": _NUMBER, "overlap": _NUMBER}, []),
    "status": ("What the index holds", {}, []),
    "health": ("Counts and invariants", {}, []),
}


class Server:
    def __init__(self, engine: Engine):
        self.engine = engine

    def call(self, name: str, a: dict):
        rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
        e = self.engine
        if name == "query":
            if e.store.status()["exists"]:
                refresh_if_stale(e.spark, e.root, e.store, e.branch)
            options = search.options_from_env(top_k=a.get("top_k", 10), rerank="overlap" if a.get("rerank") else None, include=tuple(a.get("glob", ())), **({"mode": a["mode"]} if "mode" in a else {}))
            hits = e.query(a["query"], options)
            return rows(search.summarise(hits)) if a.get("summarize") else rows(e.results(hits))
        if name == "chunk":
            return rows(e.chunk(a["ref"], a.get("before", 0), a.get("after", 0)).drop("embedding"))
        if name == "index":
            return e.index(size=a.get("chunk_lines", 60), overlap=a.get("overlap", 10))
        if name == "status":
            return e.store.status()
        if name == "health":
            return rows(e.store.health()) + rows(listing.dedup_stats(e.store.chunks()))
        raise search.SearchError(f"no tool {name!r}")

    def answer(self, message: dict) -> dict | None:
        method, params = message.get("method"), message.get("params") or {}
        if "id" not in message:
            return None
        out = {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lakeseek", "version": "1"}}}
        if method == "tools/list":
            tools = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]
            return out | {"result": {"tools": tools}}
        if method == "tools/call":
            try:
                text, failed = json.dumps(self.call(params.get("name", ""), params.get("arguments") or {}), default=str), False
            except (search.SearchError, ValueError, KeyError, OSError) as e:
                text, failed = json.dumps({"error": str(e), "error_code": getattr(e, "code", None)}), True
            return out | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
        if method == "ping":
            return out | {"result": {}}
        return out | {"error": {"code": -32601, "message": f"no method {method}"}}

    def serve(self, lines=sys.stdin, to=sys.stdout) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except json.JSONDecodeError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if reply is not None:
                to.write(json.dumps(reply) + "\n")
                to.flush()


if __name__ == "__main__":
    Server(Engine(session(), sys.argv[1] if len(sys.argv) > 1 else ".")).serve()
