"""Command line: init, migrate, index, ingest, query, ask, eval, deepeval, list, delete, serve."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from datetime import date

from pyspark.sql import SparkSession

from brindle.app import KnowledgeBase
from brindle.functions.filters import FilterError
from brindle.model import SearchRequest
from brindle.operators.answer import generate_answer
from brindle.operators.evaluate import FAILED, METRIC_SETS, THRESHOLDS
from brindle.plans.store import HEAD
from brindle.sources.files import read_cases


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="brindle")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    p = sub.add_parser("migrate")
    p.add_argument("revision", nargs="?", default="head", help="head, base, a number, or -1")
    p.add_argument("--status", action="store_true")
    sub.add_parser("index", help="index the stored vectors for approximate search")
    p = sub.add_parser("ingest")
    p.add_argument("paths", nargs="+")
    p.add_argument("--metadata", type=json.loads)
    p.add_argument("--replace", action="store_true")
    p.add_argument("--doc-key", help="for a single file")
    for name in ("--valid-from", "--valid-until", "--review-by"):
        p.add_argument(name, type=date.fromisoformat)
    for name in ("query", "ask"):
        p = sub.add_parser(name)
        p.add_argument("text")
        p.add_argument("--candidate-k", type=int, default=40)
        p.add_argument("--filter", "--filters", dest="filters", type=json.loads)
        p.add_argument("--json", action="store_true")
        _search_flags(p)
    p = sub.add_parser("eval")
    p.add_argument("questions")
    p.add_argument("--compare", action="store_true")
    p.add_argument("--out", "--output")
    _search_flags(p)
    p.add_argument("--delay", type=float, default=0.0)
    p = sub.add_parser("deepeval")
    p.add_argument("questions")
    p.add_argument("--metrics", choices=["all", "retrieval", "answer"], default="all")
    p.add_argument("--limit", type=int)
    p.add_argument("--only", help="ids, parted by commas")
    p.add_argument("--out", "--output")
    p.add_argument("--resume", action="store_true")
    _search_flags(p)
    p.add_argument("--delay", type=float, default=0.0)
    p = sub.add_parser("list")
    p.add_argument("--all", "--history", dest="history", action="store_true")
    sub.add_parser("delete").add_argument("id")
    p = sub.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    return out


def _search_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--top-k", type=int, default=3)
    p.add_argument("--min-score", type=float)
    p.add_argument("--no-hybrid", action="store_true")
    p.add_argument("--no-rerank", action="store_true")


def shown(text: str) -> str:
    """One line of at most 300 characters."""
    flat = text.replace("\n", " ")
    return flat if len(flat) <= 300 else flat[:300] + "..."


def _judged(report: dict, metrics: str) -> int:
    """Prints a judged run; 1 if questions failed."""
    summary, cases = report["summary"], report["cases"]
    print(f"{summary['questions_judged']} questions judged, {summary['skipped_no_reference']} without a reference skipped, {summary['refused']} refused")
    for name in METRIC_SETS[metrics]:
        own = summary[name]
        print(f"{name:<22} mean {own['mean']}, passed {own['pass_rate']} (at {THRESHOLDS[name]}), errors {own['errors']}")
        worst = sorted((c for c in cases if c["scores"][name]["score"] is not None and not c["scores"][name]["passed"]), key=lambda c: c["scores"][name]["score"])
        for c in worst[:10]:
            print(f"  {c['scores'][name]['score']:<6} {c['id']}: {shown(c['question'])}")
    if summary["rerank_fallbacks"]:
        print(f"reranking failed for {summary['rerank_fallbacks']} questions")
    failed = [c["id"] for c in cases if c["status"] in FAILED]
    if failed:
        print(f"search or answer failed for {', '.join(failed)}; --resume tries them again", file=sys.stderr)
    return int(bool(failed))


def main(argv: list[str] | None = None, kb: KnowledgeBase | None = None) -> int:
    args = parser().parse_args(argv)
    kb = kb or KnowledgeBase(SparkSession.builder.appName("brindle").getOrCreate())
    if args.command == "init":
        print(kb.init())
    elif args.command == "migrate":
        if args.status:
            print(f"schema version {kb.store.revision or 0}, latest {HEAD}")
        else:
            print(f"schema version {kb.store.migrate(args.revision)}")
    elif args.command == "index":
        print(kb.build_index())
    elif args.command == "ingest":
        if args.doc_key and len(args.paths) > 1:
            print("--doc-key is for a single file", file=sys.stderr)
            return 2
        results = [r for path in args.paths for r in kb.ingest_path(path, args.metadata, args.replace, args.doc_key, args.valid_from, args.valid_until, args.review_by)]
        for r in results:
            print(f"{r['status']:<10} {r['filename']}" + (f" v{r['version']}, {r['num_chunks']} chunks" if r["version"] else "") + (f": {r['error']}" if r["error"] else ""))
        return int(any(r["status"] == "error" for r in results))
    elif args.command in ("query", "ask"):
        try:
            request = SearchRequest(args.text, args.top_k, args.candidate_k, args.filters, not args.no_hybrid, not args.no_rerank, args.min_score)
            response = kb.search(request)
        except FilterError as e:
            print(f"invalid filter: {e}", file=sys.stderr)
            return 2
        if args.json:
            print(json.dumps(asdict(response), indent=2, ensure_ascii=False, default=str))
        elif args.command == "ask":
            print(generate_answer(response, kb.chat))
            for r in response.results:
                print(f"  {r['label']} {r['filename']}" + (f", p. {r['page']}" if r["page"] else ""))
        else:
            for warning in response.warnings:
                print(f"warning: {warning}")
            for r in response.results:
                print(f"{r['label']} {r['locator']} ({r['found_by']}, {r['vector_score']})\n    {shown(r['text'])}")
            print(response.message or "", end="")
    elif args.command == "eval":
        reports = kb.evaluate(read_cases(kb.spark, args.questions), args.compare, args.top_k, args.min_score, not args.no_hybrid, not args.no_rerank, args.delay)
        for name, report in reports.items():
            print(name, json.dumps(report["summary"]))
            for f in report["failures"]:
                print(f"  {f['kind']:<9} {f['id']}: {f['question']}")
        if args.out:
            with open(args.out, "w", encoding="utf-8") as out:
                json.dump(reports, out, indent=2)
    elif args.command == "deepeval":
        if args.resume and not args.out:
            print("--resume needs --out, the report of the interrupted run", file=sys.stderr)
            return 1
        only = args.only.split(",") if args.only else None
        report = kb.judge_cases(read_cases(kb.spark, args.questions), args.metrics, args.top_k, args.min_score, not args.no_hybrid, not args.no_rerank, args.delay, only, args.limit, args.out, args.resume)
        return _judged(report, args.metrics)
    elif args.command == "list":
        for d in kb.documents(include_history=args.history):
            print(d["id"], d["filename"], f"v{d['version']}", "" if d["is_current"] else "superseded")
    elif args.command == "delete":
        if not kb.delete(args.id):
            print("no such document", file=sys.stderr)
            return 1
    elif args.command == "serve":
        from brindle.server import serve

        serve(kb, args.host, args.port)
    return 0


if __name__ == "__main__":
    sys.exit(main())
