"""python -m quillon: evaluate an expression, search for expressions, or run a named query."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillon")
    out.add_argument("--tables", required=True, help="folder of the Parquet tables")
    sub = out.add_subparsers(dest="command", required=True)
    one = sub.add_parser("evaluate", help="one expression through evaluation methods")
    one.add_argument("expression")
    one.add_argument("--methods", default="rank_ic,rank_icir")
    one.add_argument("--groups", type=int, default=10)
    one.add_argument("--horizon", type=int, default=1)
    one.add_argument("--decay", type=int, default=1)
    one.add_argument("--first")
    one.add_argument("--last")
    many = sub.add_parser("search", help="genetic search")
    many.add_argument("--size", type=int, default=1000)
    many.add_argument("--generations", type=int, default=3)
    many.add_argument("--fame", type=int, default=100)
    many.add_argument("--seed", type=int, default=1)
    many.add_argument("--mode", default="none", help="how factors are prepared: paper_local, market_cap, market_cap_industry, none")
    blend = sub.add_parser("train", help="fit a blend of expressions")
    blend.add_argument("expressions", nargs="+")
    blend.add_argument("--model", default=None)
    blend.add_argument("--horizon", type=int, default=1)
    blend.add_argument("--first")
    blend.add_argument("--last")
    query = sub.add_parser("query", help="a registered query")
    query.add_argument("name")
    query.add_argument("--to", help="folder to write Parquet to, instead of showing rows")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    if args.command == "query":
        from quillon import queries, studies

        rows = {**queries.queries(), **studies.queries()}[args.name](spark, args.tables)
        rows.write.parquet(args.to) if args.to else rows.show(50, False)
        return
    from quillon.operators import models, pipeline, search
    from quillon.sources.panel import weekly_panel

    panel = weekly_panel(spark, args.tables)
    if args.command == "search":
        settings = search.Settings(size=args.size, generations=args.generations, seed=args.seed, fame=args.fame, components=args.fame, tournament=min(20, args.size), mode=args.mode)
        rows, _ = search.context(panel, settings)
        print(json.dumps(search.search(search.scorer(rows, settings), settings), indent=1))
        return
    if args.command == "train":
        terms = {f"f{k}": x for k, x in enumerate(args.expressions, 1)}
        print(json.dumps(models.train(panel, terms, args.model, horizon=args.horizon, first=args.first, last=args.last), indent=1))
        return
    state = pipeline.evaluate(panel, args.expression, args.methods.split(","), args.groups, args.horizon, args.decay, args.first, args.last)
    for name, value in state.outputs.items():
        print(f"== {name}")
        value.show(20, False) if isinstance(value, DataFrame) else print(json.dumps(value, default=str))


if __name__ == "__main__":
    main()
