"""Command line: ``python -m nearfield audit|search|plan ...``."""

from __future__ import annotations

import argparse
import json


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("nearfield").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def audit(args: argparse.Namespace) -> None:
    """A curve from files: along a column of the evaluation table, or along the highest similarity of an edge table."""
    from nearfield.operators import curve
    from nearfield.sources import readers, sinks

    spark = _session()
    thresholds = curve.parse_thresholds(args.thresholds)
    numbers = (args.target, args.prediction, *([args.axis] if args.axis else []))
    evals = readers.read_csv(spark, args.eval, [args.target, args.prediction], numbers)
    if args.edges:
        c = curve.pairwise_curve(evals, readers.read_edges(spark, args.edges), thresholds, args.bins, y_true=args.target, y_pred=args.prediction)
    else:
        c = curve.axis_curve(evals, args.axis, args.axis_type, thresholds, args.bins, y_true=args.target, y_pred=args.prediction)
    rows = sinks.curve_rows(c)
    card = sinks.audit_card(c, {"overlap": curve.validate_overlap(c).first().asDict(), "area": curve.area(c).first().asDict()})
    sinks.write_json(card, f"{args.out}/card.json")
    for name, text in (("curve.svg", sinks.svg_curve(rows, "rmse", "rmse over novelty")), ("report.md", sinks.markdown_report("Audit", rows, ["subset", "test_size", "mean_novelty", "mae", "rmse"]))):
        with open(f"{args.out}/{name}", "w", encoding="utf-8") as f:
            f.write(text)


def search(args: argparse.Namespace) -> None:
    from nearfield.operators import registry
    from nearfield.plans import strategies

    for row in registry.search(strategies.entries(_session()), args.query, k=args.k).collect():
        print(row["score"], row["catalog"], row["id"], row["operator"], sep="\t")


def plan(args: argparse.Namespace) -> None:
    from nearfield.plans import planner

    print(json.dumps(planner.choose(args.train, args.eval).__dict__))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="nearfield")
    commands = parser.add_subparsers(required=True)
    a = commands.add_parser("audit")
    a.add_argument("--eval", required=True)
    a.add_argument("--edges")
    a.add_argument("--axis")
    a.add_argument("--axis-type", default="similarity")
    a.add_argument("--target", default="y_true")
    a.add_argument("--prediction", default="y_pred")
    a.add_argument("--thresholds")
    a.add_argument("--bins", type=int, default=5)
    a.add_argument("--out", required=True)
    a.set_defaults(run=audit)
    s = commands.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=8)
    s.set_defaults(run=search)
    p = commands.add_parser("plan")
    p.add_argument("--train", type=int, required=True)
    p.add_argument("--eval", type=int)
    p.set_defaults(run=plan)
    args = parser.parse_args(argv)
    if args.run is audit and not args.edges and not args.axis:
        parser.error("audit needs --edges or --axis")
    args.run(args)


if __name__ == "__main__":
    main()
