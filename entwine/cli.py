"""Commands: ingest, serve, reconcile, enrich, evaluate, sample-cohort, sample-gold, split-gold, analyse."""

from __future__ import annotations

import argparse
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from entwine.config import MatchConfig
from entwine.operators import analysis, evaluation, experiments, intervals, reconcile, sampling

from entwine.sources import lookup, registry, tabular


def rows_of(df) -> list[dict]:
    """The rows of a small result."""
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def ingest(spark, args) -> int:
    """Registry file to index."""
    return registry.write_index(*registry.tables(registry.parse_records(registry.read_records(spark, args.source))), args.index)


def run_reconcile(spark, args) -> None:
    orgs, names = registry.read_index(spark, args.index)
    rows, evidence, counts = reconcile.reconcile(tabular.read_participants(spark, args.source, args.limit), names, orgs)
    tabular.write_csv(rows.orderBy("row_idx").drop("row_idx", "identity"), args.output)
    if args.evidence:
        tabular.write_jsonl(evidence, args.evidence)
    print(rows_of(counts)[0])


def run_enrich(spark, args) -> None:
    rows = tabular.read_csv(spark, args.source)
    found = lookup.Institutions(args.cache).table(spark, rows, args.refresh)
    tabular.write_csv(reconcile.enrich(rows, found, args.from_year, args.to_year), args.output)


def run_analyse(spark, args) -> None:
    rows = tabular.read_csv(spark, args.source).withColumn("row_idx", F.monotonically_increasing_id())
    orgs = analysis.organizations(rows).persist()
    tabular.write_csv(orgs, f"{args.output}-organizations.csv")
    tabular.write_csv(analysis.groups(orgs), f"{args.output}-groups.csv")
    tabular.write_json(rows_of(analysis.summary(rows, orgs))[0], f"{args.output}-summary.json")


def run_evaluate(spark, args) -> None:
    orgs, names = registry.read_index(spark, args.index)
    cases = evaluation.validate(evaluation.gold_cases(tabular.read_csv(spark, args.gold)))
    config = MatchConfig()
    found = experiments.evaluate(cases, names, orgs, config).persist()
    ids: dict[str, list[str]] = {}
    for r in evaluation.error_cases(found).toLocalIterator():
        ids.setdefault(r["error"], []).append(r["case_id"])
    errors = [r | {"case_ids": sorted(ids.get(r["error"], []))} for r in rows_of(evaluation.errors(found))]
    out = {"summary": rows_of(evaluation.summarize(found)), "errors": errors, "configuration": asdict(config), "confidence": args.confidence, "iterations": args.iterations, "seed": args.seed}
    out["intervals"] = rows_of(evaluation.bootstrap(found, args.iterations, args.seed, args.confidence))
    out["exact_intervals"] = rows_of(intervals.report(found, args.confidence))
    if args.ablation:
        out["ablation"] = rows_of(experiments.ablation(cases, names, orgs, config))
    if args.sweep:
        out["sweep"] = rows_of(experiments.sweep(cases, names, orgs, base=config))
    if args.hosted_cache:
        hosted = lookup.HostedSearch(args.hosted_cache)
        for r in cases.select("query").distinct().toLocalIterator():
            hosted.search(r["query"], args.refresh)
        hosted.save()
        out["hosted"] = rows_of(evaluation.summarize(evaluation.hosted_outcomes(cases, hosted.table(spark))))
    tabular.write_json(out, args.output)
    if args.cases:
        tabular.write_csv(found, args.cases)


def run_sample(spark, args) -> None:
    rows = tabular.read_participants(spark, args.source)
    tabular.write_csv(sampling.cohort(rows, args.size, args.seed).orderBy("row_idx").drop("row_idx"), args.output)


def run_gold(spark, args) -> None:
    tabular.write_gold(evaluation.gold_cases(sampling.gold_template(tabular.read_participants(spark, args.source), args.size, args.seed)), args.output)


def run_split(spark, args) -> None:
    cases = evaluation.validate(evaluation.gold_cases(tabular.read_csv(spark, args.source)))
    parts = sampling.split(cases, args.fraction, args.seed).persist()
    for part in ("dev", "test"):
        tabular.write_gold(parts.where(F.col("part") == part), f"{args.output}-{part}.csv")


def run_serve(spark, args) -> None:
    from entwine.openrefine import serve

    orgs, names = registry.read_index(spark, args.index)
    with serve(spark, names, orgs, args.host, args.port) as server:
        server.serve_forever()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="entwine", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        for flag, settings in options:
            own.add_argument(flag, **settings)

    need = dict(required=True)
    number = lambda n: dict(type=int, default=n)
    index, source, output, seed = ("--index", need), ("--source", need), ("--output", need), ("--seed", number(42))
    command("ingest", ingest, source, index)
    command("serve", run_serve, index, ("--host", dict(default="127.0.0.1")), ("--port", number(8000)))
    command("reconcile", run_reconcile, source, index, output, ("--evidence", {}), ("--limit", dict(type=int)))
    command("enrich", run_enrich, source, output, ("--cache", need), ("--from-year", dict(type=int, required=True)), ("--to-year", dict(type=int, required=True)), ("--refresh", dict(action="store_true")))
    command("analyse", run_analyse, source, output)
    command("evaluate", run_evaluate, index, ("--gold", need), output, seed, ("--cases", {}), ("--iterations", number(2000)), ("--confidence", dict(type=float, default=0.95)), ("--ablation", dict(action="store_true")), ("--sweep", dict(action="store_true")), ("--hosted-cache", {}), ("--refresh", dict(action="store_true")))
    command("sample-cohort", run_sample, source, output, seed, ("--size", number(300)))
    command("sample-gold", run_gold, source, output, seed, ("--size", number(150)))
    command("split-gold", run_split, source, output, seed, ("--fraction", dict(type=float, default=0.5)))
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("entwine").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
