"""python -m lodestone [FILE | -q SQL | < FILE] [--json] [--out FILE]: the advisor's report on a statement."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone", description="report on a SQL statement")
    p.add_argument("file", nargs="?", help="a file with the statement; without it and -q, standard input")
    p.add_argument("-q", "--query")
    p.add_argument("--json", action="store_true")
    p.add_argument("--out", help="write the report here instead of printing it")
    p.add_argument("--save", help="write the rewritten statement here")
    a = p.parse_args(args)
    sql = a.query or (Path(a.file).read_text() if a.file else sys.stdin.read())
    from pyspark.errors import ParseException
    from pyspark.sql import SparkSession

    from .advisor.advise import optimize

    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        report = optimize(spark, sql, plan=False)  # the tables need not exist here
    except ParseException as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 2
    text = report.as_json() if a.json else report.as_text()
    if a.save:
        Path(a.save).write_text(report.optimized.rstrip() + "\n")
    if a.out:
        Path(a.out).write_text(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
