"""``python -m tablesense.cli``: status of a folder of tasks, one task's files, a registered query, scores of a run."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from tablesense.session import session
from tablesense.sources import files as S


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tablesense")
    commands = parser.add_subparsers(dest="command", required=True)
    status = commands.add_parser("status", help="tasks by difficulty")
    status.add_argument("root")
    inspect = commands.add_parser("inspect-task", help="a task's question and files")
    inspect.add_argument("root")
    inspect.add_argument("task")
    run = commands.add_parser("run-query", help="a registered query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--rows", type=int, default=20)
    score = commands.add_parser("score", help="a prediction against its gold table, both CSV")
    score.add_argument("gold")
    score.add_argument("prediction")
    whole = commands.add_parser("score-run", help="all predictions of a run's folder against a folder of gold tables")
    whole.add_argument("run")
    whole.add_argument("gold")
    whole.add_argument("--penalty", type=float, default=0.5)
    whole.add_argument("--no-summary", action="store_true", help="don't write score_summary.json")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "status":
        S.tasks(spark, args.root).groupBy("difficulty").agg(F.count("*").alias("tasks")).orderBy("difficulty").show()
    elif args.command == "inspect-task":
        S.tasks(spark, args.root, ids=[args.task]).show(truncate=False)
        S.listing(spark, S.resolve(args.root, f"{args.task}/context")).orderBy("path").show(truncate=False)
    elif args.command == "run-query":
        from tablesense.plans import catalog

        catalog.QUERIES[args.name](spark, args.tables).show(args.rows, truncate=False)
    elif args.command == "score-run":
        from tablesense.operators.answers import run_summary
        from tablesense.sources.runs import score_folder, write_score_summary

        scores = score_folder(spark, args.run, args.gold, args.penalty).cache()
        scores.orderBy("task_id").show(1000, truncate=False)
        print(json.dumps(run_summary(scores).first().asDict()))
        if not args.no_summary:
            print(write_score_summary(spark, scores, args.run))
    else:
        from tablesense.operators.answers import score_table

        row = score_table(S.read_delimited(spark, args.gold), S.read_delimited(spark, args.prediction)).first()
        print(json.dumps(row.asDict()))


if __name__ == "__main__":
    main()
