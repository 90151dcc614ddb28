"""Command line: config-check, run (a registered query), manifest-check, safety-check, ingest, ask, eval.

Models are factories named as ``module:function``; ``local`` is the deterministic stand-in embedder.
Documents are a Parquet table of a manifest's columns and ``html``; questions one of question_id and question (eval: and
supported, facts, gold).
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import SparkSession

from corpusloom.shared import Settings


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("config-check", help="check the settings' ranges")
    q = sub.add_parser("run", help="run a registered query and write it")
    q.add_argument("query")
    q.add_argument("data", help="folder of Parquet tables")
    q.add_argument("out", help="Parquet output")
    m = sub.add_parser("manifest-check", help="validate a manifest")
    m.add_argument("path")
    s = sub.add_parser("safety-check", help="totals over a JSON-lines file of labelled cases (kind, text, values)")
    s.add_argument("path")
    i = sub.add_parser("ingest", help="build or renew the index; --prepare-only stops before any embedding")
    i.add_argument("documents")
    i.add_argument("index")
    i.add_argument("--prepare-only", action="store_true")
    i.add_argument("--keep", action="store_true", help="keep documents that aren't in the table")
    for name, text in (("ask", "answer questions"), ("eval", "score the answers of every variant")):
        a = sub.add_parser(name, help=text)
        for what in ("questions", "documents", "index", "out"):
            a.add_argument(what)
        a.add_argument("--chat", required=True)
        if name == "eval":
            a.add_argument("--judge", required=True)
        else:
            a.add_argument("--vectors", help="folder of stored question vectors")
    for c in (i, *(sub.choices[n] for n in ("ask", "eval"))):
        c.add_argument("--embedder", default="local")
        c.add_argument("--landmark", default="main")
        c.add_argument("--report", help="where the run report is written, whatever happens")
    args = p.parse_args(argv)
    if args.command == "config-check":
        print(json.dumps(Settings().__dict__))
        return 0
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if args.command == "run":
        from corpusloom.plans import registry

        registry.queries()[args.query](spark, args.data).write.parquet(args.out)
    elif args.command == "manifest-check":
        from corpusloom.sources import manifest

        print(manifest.load(spark, args.path).count())
    elif args.command in ("ingest", "ask", "eval"):
        return _pipeline(spark, args)
    else:
        from corpusloom.functions import redaction
        from corpusloom.functions import text as T
        from corpusloom.operators import scoring

        cases = T.normalize_column(spark.read.schema("kind string, text string, values array<string>").json(args.path), "text")
        print(scoring.safety(cases, redaction.NAMES).toJSON().first())
    return 0


def _factory(name: str) -> Callable:
    from corpusloom import models

    if name == "local":
        return models.hashed_embedder(Settings().dimension)
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _pipeline(spark: SparkSession, args: argparse.Namespace) -> int:
    from corpusloom.operators.question_vectors import QuestionVectors
    from corpusloom.operators.store import VectorStore
    from corpusloom.plans import ask, evaluate, ingest

    settings, documents = Settings(), spark.read.parquet(args.documents)
    made = ingest.fingerprint_columns(args.embedder, args.embedder, settings, "document")
    identity = {"backend": args.embedder, "model": args.embedder, "dimension": settings.dimension, "fingerprint": spark.range(1).select(made["fingerprint"]).first()[0]}
    index, embedder = VectorStore(spark, args.index, identity), _factory(args.embedder)
    if args.command == "ingest":
        report = ingest.run(documents, index, embedder, settings, args.embedder, args.landmark, args.prepare_only, not args.keep, args.report)
        print(json.dumps(asdict(report)))
        return 0
    index.assert_identity()
    corpus, questions = index.rows(), spark.read.parquet(args.questions)
    if corpus is None:
        raise ValueError("the index is empty")
    if args.command == "ask":
        vectors = QuestionVectors(spark, args.vectors, identity, args.embedder) if args.vectors else None
        found, cited = ask.ask(questions, corpus, documents, embedder, _factory(args.chat), settings, vectors, args.report)
        found.write.parquet(f"{args.out}/answers")
        cited.write.parquet(f"{args.out}/citations")
    else:
        scores, outcomes = evaluate.run(questions, corpus, documents, embedder, _factory(args.chat), _factory(args.judge), settings, args.report)
        scores.write.parquet(f"{args.out}/scores")
        outcomes.write.parquet(f"{args.out}/outcomes")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
