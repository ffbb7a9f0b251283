"""Command line: python -m spindrift.cli COMMAND. Every command prints JSON.

Exit codes: 0 done or go, 1 findings, refused or no-go, 2 an error, 3 unfinished or inconclusive.
"""

from __future__ import annotations

import argparse
import json
import sys

from spindrift import service
from spindrift.functions.identity import fingerprint
from spindrift.plans import job, spec, verdict
from spindrift.sources import jsonl, tables


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("spindrift").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *names: str, **options):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        for k, kind in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind}))
        return c

    add("fingerprint", "provider", "model", "dimensions", version=str, task=str, prefix=str, unnormalized=bool)
    add("doctor", "table", vector=str, text_column=str, sample=int, declared=int)
    add("init", "table", "model", column=str, budget=float)
    add("plan", "job", probe=bool)
    for name in ("apply", "status", "cutover", "rollback"):
        add(name, "job", "work", **({"until": float} if name == "apply" else {"check": bool} if name == "cutover" else {}))
    add("cleanup", "job", "work", "typed")
    add("eval", "job", "work", queries=int, tolerance=float, min_slice=int, lists=int, probes=int, sweep=str, timed=int, max_p95_ms=float, max_slowdown_pct=float, least_index_recall=float)
    c = add("bench", "docs", queries=int, labelled=str, seed=str)
    c.add_argument("--model", action="append", required=True)
    return p


def run(args: argparse.Namespace) -> tuple[dict | str, int]:
    if args.command == "fingerprint":
        f = fingerprint(args.provider, args.model, int(args.dimensions), args.version, args.task, args.prefix, not args.unnormalized)
        return {n: f[n] for n in ("tag", "digest")}, 0
    if args.command == "init":
        return job.template(args.table, args.model, args.column or "new_vector", budget=args.budget), 0
    spark = _session()
    if args.command == "doctor":
        out = service.doctor(spark.read.parquet(args.table), args.vector, args.text_column, args.sample, declared=args.declared)
        return out, int(any(f["severity"] == "error" for f in out["findings"]))
    if args.command == "bench":
        docs = jsonl.load_documents(spark, args.docs)
        out = service.bench(docs, [spec.parse(m) for m in args.model], args.queries or 100, args.seed or "0", jsonl.load_queries(spark, args.labelled) if args.labelled else None)
        return out, 0
    j = job.load(args.job)
    if args.command == "plan":
        out = service.plan(spark, j, args.probe)
        return out, int(not out["ok"])
    t = tables.VectorTable(spark, args.work)
    if args.command == "apply":
        out = service.apply(spark, j, args.work, args.until)
        return out, {"complete": 0, "refused": 1, "failed": 2}.get(out["status"], 3)
    if args.command == "status":
        return service.status(spark, j, args.work), 0
    if args.command == "eval":
        gates = verdict.Gates(**{k: v for k in ("tolerance", "min_slice", "max_p95_ms", "max_slowdown_pct", "least_index_recall") if (v := getattr(args, k)) is not None})
        rows = t.read("new")
        sweep = tuple(int(p) for p in (args.sweep or "").split(",") if p)
        out = service.evaluate(
            rows, spec.parse(j.source.model) if j.source.model else None, j.model, args.queries or 200, gates=gates, group=service.groups(spark, j, rows),
            lists=args.lists or 0, probes=args.probes or 4, sweep=sweep, timed=args.timed or 0,
        )
        return out, verdict.EXIT_CODES[out["verdict"]["status"]]
    if args.command == "cutover":
        now = service.status(spark, j, args.work)
        if args.check or now["stage"] not in ("ready", "filling"):
            return now, int(now["stage"] != "ready")
        out = service.cutover(spark, j, args.work)
        return out, int("pending" in out)
    elif args.command == "rollback":
        return service.rollback(spark, j, args.work), 0
    else:
        t.cleanup(args.typed)
    return {"stage": t.stage}, 0


def main(argv: list[str] | None = None) -> int:
    try:
        out, code = run(parser().parse_args(argv))
    except (ValueError, OSError) as e:
        out, code = {"error": str(e)}, 2
    print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
