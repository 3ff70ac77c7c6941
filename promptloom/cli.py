"""``python -m promptloom.cli list | query NAME FOLDER [--out PATH] | run CONFIG``"""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="promptloom")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of methods, datasets and queries")
    q = sub.add_parser("query", help="run a query over a folder of tables")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--out", help="write Parquet there instead of showing rows")
    r = sub.add_parser("run", help="search for a prompt by a JSON or YAML configuration")
    r.add_argument("config")
    args = parser.parse_args(argv)

    from .plans import catalogue
    from .search.methods import METHODS, method
    from .sources.datasets import READERS, load_dataset, split_by_seed

    if args.command == "list":
        print(json.dumps({"methods": sorted(METHODS), "datasets": sorted(READERS), "queries": sorted(catalogue.QUERIES)}, indent=1))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("promptloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "query":
        df = catalogue.QUERIES[args.name](spark, args.folder)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=False)
        return 0
    from .plans.budget import Budget, load_config
    from .search.client import StubClient
    from .search.loop import Search

    c = load_config(args.config)
    data = c["dataset"]
    samples = load_dataset(spark, data["name"], data["path"])
    if not samples.where("split is not null").limit(1).count():
        samples = split_by_seed(samples, c.get("seed", 42))
    found = Search(spark, samples, StubClient, method(c["method"]), c.get("task_type", "auto"), c.get("seed", 42), budget=Budget(**c.get("budget", {}))).run(c["prompts"])
    print(json.dumps({"best_prompt": found.best_prompt, "best_score": found.best_score, "test_score": found.test_score, "stopped": found.stopped}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
