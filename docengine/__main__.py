"""python -m docengine ingest | query | collections | eval | serve"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import providers
from .config import load
from .operators import metrics
from .plans.engine import Engine
from .server import server
from .sources import dataset


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docengine")
    top.add_argument("--store", help="folder of the chunk store")
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="store a file or a folder of files")
    ingest.add_argument("path")
    ingest.add_argument("--collection", default="default")
    ask = commands.add_parser("query", help="answer a question")
    ask.add_argument("question")
    ask.add_argument("--collection", default="default")
    ask.add_argument("--top-k", type=int)
    ask.add_argument("--json", action="store_true", help="print the whole answer")
    commands.add_parser("collections", help="list collections")
    serve = commands.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    ev = commands.add_parser("eval", help="measure answers to a set of examples")
    ev.add_argument("--dataset", required=True)
    ev.add_argument("--docs", help="files to store first, in every collection that the examples name")
    ev.add_argument("--collection")
    ev.add_argument("-k", type=int, default=5)
    ev.add_argument("--mode", default="hybrid", choices=("hybrid", "vector", "keyword"))
    ev.add_argument("--judge", action="store_true")
    ev.add_argument("--output")
    ev.add_argument("--verbose", action="store_true")
    for gate in ("hit", "mrr", "groundedness"):
        ev.add_argument(f"--min-{gate}", type=float)
    return top


def evaluate(engine: Engine, a: argparse.Namespace) -> int:
    if a.judge and engine.llm is None:
        print("a judge needs a model provider", file=sys.stderr)
        return 2
    examples = dataset.read_examples(engine.spark, a.dataset)
    if a.docs:
        named = examples.select(F.coalesce("collection", F.lit(a.collection)).alias("c")).where("c is not null").distinct()
        for r in named.collect():
            engine.ingest_path(r.c, a.docs)
    measured = engine.evaluate(examples, a.collection, a.k, a.mode, engine.llm if a.judge else None).persist()
    figures = metrics.summary(measured, a.k).first().asDict()
    for name, value in figures.items():
        print(f"{name:20} {value}")
    if a.verbose:
        for r in metrics.misses(measured).select("id", "question", "expected_sources", "retrieved_labels").collect():
            print(f"missed {r.id}: {r.question} expected {r.expected_sources}, got {r.retrieved_labels}")
    if a.output:
        rows = [json.loads(x) for x in measured.drop("sources").toJSON().collect()]
        with open(a.output, "w", encoding="utf-8") as f:
            json.dump({"k": a.k, "mode": a.mode, "summary": figures, "results": rows}, f, indent=2, ensure_ascii=False)
    failed = metrics.failed_gates(figures, {f"hit@{a.k}": a.min_hit, "mrr": a.min_mrr, "groundedness": a.min_groundedness})
    for line in failed:
        print(f"FAILED: {line}", file=sys.stderr)
    return int(bool(failed))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    settings = load(**({"store_path": a.store} if a.store else {}))
    engine = Engine(spark or SparkSession.builder.appName("docengine").getOrCreate(), settings, llm=providers.llm(settings))
    if a.command == "ingest":
        for r in engine.ingest_path(a.collection, a.path).collect():
            print(f"{r.document}: {r.chunks} chunks")
    elif a.command == "collections":
        for r in engine.collections().collect():
            print(f"{r.name}: {r.documents} documents, {r.chunks} chunks")
    elif a.command == "query":
        r = engine.answer(engine.questions(a.collection, a.question), a.top_k).first()
        if a.json:
            print(json.dumps({"answer": r.answer, "citations": [c.asDict() for c in r.citations], "retrieved": [c.asDict() for c in r.retrieved]}, indent=2, ensure_ascii=False))
            return 0
        print(r.answer)
        for c in r.citations:
            print(f"[{c.ref}] {c.document}" + (f", page {c.page}" if c.page else "") + (f", {c.heading}" if c.heading else ""))
    elif a.command == "serve":
        if not settings.api_keys:
            print("no API keys are set: everyone may see everything", file=sys.stderr)
        server(engine, a.host, a.port).serve_forever()
    else:
        return evaluate(engine, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
