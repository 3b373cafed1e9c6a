"""python -m spindrift.cli COMMAND PROJECT ...: validate, lint, plan, preview, generate, regenerate, transform, stream, generators, recipes."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.appName("spindrift").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "lint", "plan", "preview", "generate", "regenerate", "stream"):
        c = sub.add_parser(name)
        c.add_argument("project")
        c.add_argument("--entity")
        c.add_argument("--out", default="out")
        c.add_argument("--format", default="parquet")
        c.add_argument("--count", type=int, default=5)
        c.add_argument("--offset", type=int, default=0)
        c.add_argument("--records", default="0-0")
        c.add_argument("--policy", default="report")
        c.add_argument("--rate", action="append", default=[])
        c.add_argument("--to", action="append", default=[])
        c.add_argument("--seconds", type=float)
        c.add_argument("--max-records", type=int)
    t = sub.add_parser("transform")
    t.add_argument("source")
    t.add_argument("destination")
    t.add_argument("--where")
    t.add_argument("--set", action="append", default=[])
    t.add_argument("--drop", action="store_true")
    t.add_argument("--keep", action="store_true")
    t.add_argument("--force", action="store_true")
    sub.add_parser("generators")
    sub.add_parser("recipes")
    a = p.parse_args(argv)

    if a.command == "generators":
        from spindrift.operators.generators import ALIASES, GENERATORS

        for g in sorted(GENERATORS):
            print(g, *sorted(k for k, v in ALIASES.items() if v == g))
        return 0
    if a.command == "recipes":
        from spindrift.plans.recipes import Library

        for group, recipes in Library.of().groups().items():
            print(f"{group}: {', '.join(recipes)}")
        return 0
    spark = session()
    if a.command == "transform":
        from spindrift.sources.files import transform_file

        rule = {"where": a.where, "set": dict(s.split("=", 1) for s in a.set), "drop": a.drop, "keep": a.keep}
        print(json.dumps(transform_file(spark, a.source, a.destination, [{k: v for k, v in rule.items() if v}], force=a.force)))
        return 0
    from spindrift.plans.compiler import Project
    from spindrift.plans.lint import lint
    from spindrift.plans.spec import load
    from spindrift.sources.files import write

    project = Project(load(a.project), spark)
    names = [a.entity] if a.entity else project.order
    if a.command == "lint":
        found = lint(project)
        for f in found:
            print(f"{f.severity}: {f.rule}: {f.where}: {f.message}")
        return int(any(f.severity == "error" for f in found))
    if a.command == "plan":
        print(json.dumps(project.estimate(), indent=2))
    elif a.command == "preview":
        for n in names:
            project.frame(n, a.offset, a.count).show(a.count, truncate=60)
    elif a.command == "regenerate":
        lo, _, hi = a.records.partition("-")
        for n in names:
            for r in project.frame(n, int(lo), int(hi or lo) - int(lo) + 1).toJSON().toLocalIterator():
                print(r)
    elif a.command == "generate":
        for n in names:
            df = (project.validated(n, a.policy) if a.policy != "report" else project.records(n)).drop("_index", "_issues")
            write(df, f"{a.out}/{n}.{a.format}", a.format, mode="overwrite", table=n, relaxed=bool(project.spec.chaos))
    elif a.command == "stream":
        from spindrift.streaming.live import Live
        from spindrift.streaming.sinks import of

        stats = Live(project, dict(r.split("=", 1) for r in a.rate), [of(t) for t in a.to or ["stdout:"]]).run(a.seconds, a.max_records)
        print(json.dumps({"generated": stats.generated, "delivered": stats.delivered, "attainment": round(stats.attainment, 3)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
