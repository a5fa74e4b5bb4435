"""python -m readloom pack ARCHIVE FASTQ [WORKERS] | unpack ARCHIVE FASTQ [WORKERS] | generate FASTQ N LENGTH

A path that ends in / is a folder of archives or FASTQ files."""

from __future__ import annotations

import os
import sys

USAGE = 2


def main(args: list[str]) -> int:
    fits = args[:1] in (["pack"], ["unpack"]) and len(args) in (3, 4) or args[:1] == ["generate"] and len(args) == 4
    numbers = args[3:] if args[:1] != ["generate"] else args[2:]
    if not fits or not all(x.isdigit() for x in numbers):
        print(__doc__, file=sys.stderr)
        return USAGE
    from pyspark.sql import SparkSession

    from . import api

    workers = int(args[3]) if args[0] != "generate" and len(args) == 4 else os.cpu_count()
    spark = SparkSession.builder.master(os.environ.get("MASTER", f"local[{workers}]")).config("spark.ui.enabled", "false").getOrCreate()
    path = lambda p: p if ":" in p else os.path.abspath(p) + "/" * p.endswith("/")
    try:
        if args[0] == "generate":
            api.generate(spark, path(args[1]), int(args[2]), int(args[3]))
        else:
            print(getattr(api, args[0])(spark, path(args[1]), path(args[2])))
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
