"""python -m tideline compare LEFT RIGHT [--keys a,b] [--json], batch FILE [--json], leftovers ROOT.

LEFT and RIGHT are Parquet folders. FILE is a JSON list of objects with name, left, right and keys. The exit
code is 0 if all match, 1 if some differ, 2 if some could not be compared.
"""

from __future__ import annotations

import argparse
import json
import sys

from .operators.compare import compare, roll_up
from .plans.session import session
from .sources.store import TargetStore


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tideline", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("compare")
    one.add_argument("left")
    one.add_argument("right")
    one.add_argument("--keys", default="")
    one.add_argument("--accept", default="")
    many = sub.add_parser("batch")
    many.add_argument("file")
    left = sub.add_parser("leftovers")
    left.add_argument("root")
    for p in (one, many):
        p.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "leftovers":
        print("\n".join(TargetStore(spark, args.root).stale()))
        return 0
    if args.command == "compare":
        jobs = [{"name": args.right, "left": args.left, "right": args.right, "keys": [k for k in args.keys.split(",") if k], "accept": [a for a in args.accept.split(",") if a]}]
    else:
        jobs = json.loads("\n".join(r[0] for r in spark.read.text(args.file).collect()))
    reports = []
    for job in jobs:
        tables = []
        for side in ("left", "right"):
            path = spark._jvm.org.apache.hadoop.fs.Path(job[side])
            there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
            tables.append(spark.read.parquet(job[side]) if there else None)
        reports.append(compare(job.get("name", job["right"]), *tables, job.get("keys") or None, accept=job.get("accept", ())))
        print(reports[-1].to_json() if args.json else reports[-1].to_text())
    total = roll_up(reports)
    if len(reports) > 1:
        print(json.dumps(total))
    return total["exit_code"]


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
