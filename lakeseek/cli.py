"""Command line: python -m lakeseek.cli COMMAND. Results are JSON lines; errors are JSON with an error_code, exit code 1."""

from __future__ import annotations

import argparse
import json
import sys

from .operators import evaluate, listing, providers, search
from .operators.chunking import capabilities
from .session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakeseek")
    scope = argparse.ArgumentParser(add_help=False)
    scope.add_argument("--root", default=".")
    scope.add_argument("--db")
    scope.add_argument("--profile")
    scope.add_argument("--global-cache", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name: commands.add_parser(name, parents=[scope])
    for name in ("index", "reindex"):
        c = add(name)
        c.add_argument("--chunk-lines", type=int, default=60)
        c.add_argument("--overlap", type=int, default=10)
        c.add_argument("--no-ast", action="store_true")
        c.add_argument("--no-detect", action="store_true")
        c.add_argument("--list", action="store_true")
        c.add_argument("-m", "--model")
        c.add_argument("-e", "--exclude", action="append")
        c.add_argument("-i", "--include", action="append")
    c = add("query")
    c.add_argument("query")
    c.add_argument("-n", type=int, default=10)
    c.add_argument("--mode", choices=("hybrid", "semantic", "fulltext"), default="hybrid")
    c.add_argument("--fusion", choices=("rrf", "alpha"), default="rrf")
    c.add_argument("--branch")
    c.add_argument("--glob", action="append", default=[])
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--rerank", action="store_true")
    c.add_argument("--rerank-model", default="overlap")
    c.add_argument("--rerank-top", type=int, default=search.RERANK_TOP)
    c.add_argument("--no-cache", action="store_true")
    c.add_argument("--refresh", action="store_true")
    c.add_argument("--summarize", action="store_true")
    c.add_argument("--no-json", action="store_true")
    c.add_argument("-m", "--model")
    c = add("chunk")
    c.add_argument("ref")
    c.add_argument("-B", "--before", type=int, default=0)
    c.add_argument("-A", "--after", type=int, default=0)
    c = add("delete")
    c.add_argument("patterns", nargs="+")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--save-ignore", action="store_true")
    c = add("log")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--action")
    c.add_argument("--since")
    c.add_argument("--until")
    c = add("reset")
    c.add_argument("--branch")
    c.add_argument("--force", action="store_true")
    c = add("cache-report")
    c.add_argument("--hours", type=int, default=24)
    c.add_argument("--clear", action="store_true")
    for name in ("clean", "status", "models", "device"):
        add(name)
    add("health").add_argument("--rebuild", action="store_true", help="make the full-text index anew")
    for name in ("tune", "benchmark"):
        c = add(name)
        c.add_argument("--samples", type=int, default=10)
        c.add_argument("--sizes", type=int, nargs="*")
        c.add_argument("-m", "--model", action="append")
        c.add_argument("--save", action="store_true", help="write the best setting to .env")
    return top


def _tune(spark, engine, args) -> list[dict]:
    """Accuracy of each chunk size (and model): definitions asked for by name, found in a scratch index."""
    from .engine import Engine
    from .functions.text import decode_utf8
    from pyspark.sql import functions as F

    listed = engine.listing().where("reason is null")
    patterns = evaluate.DEFINITIONS if args.command == "tune" else evaluate.BENCHMARK_DEFINITIONS
    drawn = evaluate.significant_lines(listed.select("path", decode_utf8(F.col("content")).alias("text")), most=args.samples, patterns=patterns).collect()
    samples = spark.createDataFrame([(i, x["path"], x["line_number"]) for i, x in enumerate(drawn)], "sample_id int, path string, line_number long")
    wanted = [providers.resolve_model(m) for m in (args.model or [None])]
    models = [m for m in wanted if providers.usable_models().get(m) is None]
    out = []
    for s in evaluate.grid(spark, models, args.sizes or evaluate.CHUNK_SIZES, (5, 10, 15, 20)).collect():
        if args.command == "tune" and s["overlap"] != min(20, max(5, s["chunk_lines"] // 6 // 5 * 5)):
            continue
        other = Engine(spark, engine.root, f"{engine.store.path}/scratch")
        try:
            other.index(model=s["model"], size=s["chunk_lines"], overlap=s["overlap"])
            hits = None
            for i, x in enumerate(drawn):
                own = other.query(x["query"], search.Options(top_k=5), model=s["model"], cached=False)
                own = own.select(F.lit(i).alias("sample_id"), "path", "start_line", "end_line", "rank")
                hits = own if hits is None else hits.unionByName(own)
            if hits is not None:
                got = evaluate.weighted_accuracy(evaluate.covering_ranks(hits, samples)).first()
                out.append(s.asDict() | {"alias": providers.shortest_alias(s["model"]), "accuracy": got["accuracy"], "hits": got["hits"]})
        finally:
            other.store.reset()
    out.sort(key=lambda r: (-r["accuracy"], r["chunk_lines"]))
    if out:
        rows = spark.createDataFrame([(r["chunk_lines"], r["overlap"], float(r["accuracy"])) for r in out], "chunk_lines int, overlap int, accuracy double")
        best = evaluate.best_setting(rows).first()
        if args.save:
            from .sources.store import save_settings

            save_settings(f"{engine.root}/.env", LAKESEEK_CHUNK_LINES=best["chunk_lines"], LAKESEEK_OVERLAP=best["overlap"])
    return out + [{"model": m, "skipped": providers.usable_models()[m]} for m in wanted if m not in models]


def run(args: argparse.Namespace, spark=None) -> list[dict]:
    from .engine import Engine

    if args.command == "models":
        return [r.asDict() for r in providers.models_table(spark or session()).collect()]
    if args.command == "device":
        return [{"chunkers": capabilities(), "rerankers": providers.rerank_capabilities()}]
    spark = spark or session()
    engine = Engine(spark, args.root, args.db, args.profile, args.global_cache)
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    if args.command in ("index", "reindex"):
        if args.list:
            files = engine.listing(args.exclude, args.include, not args.no_detect)
            return [{"extensions": rows(listing.by_extension(files)), "largest": rows(listing.largest(files)), "directories": rows(listing.top_directories(files)),
                     "review": rows(listing.to_review(files).select("path", "size", "reason"))}]
        options = {"model": args.model, "chunker": "lines" if args.no_ast else "syntax", "size": args.chunk_lines, "overlap": args.overlap}
        if args.command == "reindex":
            return [engine.store.reindex(engine.listing(args.exclude, args.include, not args.no_detect).where("reason is null"), engine.branch, **options)]
        return [engine.index(args.exclude, args.include, not args.no_detect, **options)]
    if args.command == "query":
        if args.refresh:
            from .streaming.refresh import refresh_if_stale

            refresh_if_stale(spark, engine.root, engine.store, engine.branch)
        options = search.options_from_env(
            top_k=args.n, mode=args.mode, fusion=args.fusion, branch=args.branch, include=tuple(args.glob), exclude=tuple(args.exclude),
            rerank=args.rerank_model if args.rerank else None, rerank_top=args.rerank_top,
        )
        hits = engine.query(args.query, options, args.model, not args.no_cache)
        engine.flush()
        if engine.rerank_skipped:
            print(f"Results are not re-ranked: {engine.rerank_skipped}", file=sys.stderr)
        if args.no_json:
            return [r["line"] for r in engine.text_lines(hits).collect()]
        return rows(search.summarise(hits)) if args.summarize else rows(engine.results(hits))
    if args.command == "chunk":
        return rows(engine.chunk(args.ref, args.before, args.after).drop("embedding"))
    if args.command == "delete":
        out = engine.store.delete(args.patterns, engine.branch, args.dry_run)
        if args.save_ignore and not args.dry_run:
            from .sources.tree import add_ignored

            out["ignored"] = add_ignored(engine.root, args.patterns)
        return [out]
    if args.command == "log":
        page = engine.store.history_page(args.limit, args.offset, args.action, args.since, args.until)
        return [page | {"entries": [e | {"timestamp": str(e["timestamp"])} for e in page["entries"]]}]
    if args.command == "reset":
        if not args.force:
            raise search.SearchError("reset needs --force")
        return [engine.store.reset(args.branch)]
    if args.command == "clean":
        return [engine.clean()]
    if args.command == "status":
        return [engine.store.status()]
    if args.command == "health":
        if args.rebuild:
            engine.store.rebuild_full_text()
        return rows(engine.store.health()) + rows(listing.dedup_stats(engine.store.chunks()))
    if args.command == "cache-report":
        if args.clear:
            engine.clear_cache()
        return rows(engine.cache_report(args.hours))
    return _tune(spark, engine, args)


def main(argv: list[str] | None = None) -> int:
    try:
        for row in run(parser().parse_args(argv)):
            print(row if isinstance(row, str) else json.dumps(row, default=str))
        return 0
    except KeyboardInterrupt:
        return 130
    except (search.SearchError, ValueError, OSError) as e:
        code = getattr(e, "code", None) or ("MODEL_MISMATCH" if "MODEL_MISMATCH" in str(e) else None)
        print(json.dumps({"error": str(e)} | ({"error_code": code} if code else {})))
        return 1


if __name__ == "__main__":
    sys.exit(main())
