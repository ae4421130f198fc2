"""python -m reprise: scan session files below a home folder and report repeated work."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .plans import scan as P


def positive(value: str) -> int:
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError(f"must be 1 or more, not {n}")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reprise", description=__doc__)
    for name, value in (("--days", 14), ("--top", 3), ("--min-runs", 3), ("--suggest-rank", 1)):
        p.add_argument(name, type=positive, default=value)
    p.add_argument("--home", default=os.path.expanduser("~"))
    p.add_argument("--format", choices=("text", "json"), default="text")
    p.add_argument("--out")
    p.add_argument("--redact", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--suggest", action="store_true", help="print the slots and steps of one candidate")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("reprise").getOrCreate()
    done = P.scan(spark, a.home, datetime.now(UTC).isoformat(timespec="seconds"), a.days, a.min_runs)
    if a.suggest:
        said = json.dumps(P.scaffold(done, a.suggest_rank), indent=2, ensure_ascii=False) + "\n"
    else:
        said = (P.json_report if a.format == "json" else P.text_report)(P.report(done, a.top, a.redact))
    if a.out:
        try:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(said)
            return 0
        except OSError as e:
            print(f"{a.out} can't be written: {e}", file=sys.stderr)
    sys.stdout.write(said)
    return 0


if __name__ == "__main__":
    sys.exit(main())
