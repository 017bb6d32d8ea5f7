"""Run analyses from the command line.

    python -m rosterlens --sf-dir /root/testdata/sf0.01 q1_1_flow 'q5_*'
    python -m rosterlens --sf-dir /root/testdata/sf0.01 --out /shared/reports

Without keys every analysis runs. Results are shown (like the printed
tables of the studied analysis) or, with ``--out``, written as Parquet,
one folder per key.
"""

from __future__ import annotations

import argparse
import fnmatch
import sys

from pyspark.sql import SparkSession

from rosterlens.plans import ANALYSES, workforce
from rosterlens.session import build_session


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m rosterlens", description=__doc__.split("\n\n")[0])
    ap.add_argument("keys", nargs="*", help="analysis keys or glob patterns (default: all)")
    ap.add_argument("--sf-dir", required=True, help="folder with orders/customer/nation parquet")
    ap.add_argument("--out", help="write each result as Parquet under this folder instead of showing it")
    ap.add_argument("--rows", type=int, default=50, help="rows to show per result")
    ap.add_argument("--master", default="local[*]")
    args = ap.parse_args(argv)

    patterns = args.keys or ["*"]
    keys = [k for k in ANALYSES if any(fnmatch.fnmatch(k, p) for p in patterns)]
    if not keys:
        print(f"no analysis matches {patterns}", file=sys.stderr)
        return 2
    own_session = SparkSession.getActiveSession() is None
    spark = build_session(master=args.master)
    w = workforce(spark, args.sf_dir)
    for key in keys:
        df = ANALYSES[key](w)
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{key}")
            print(f"wrote {key}")
        else:
            print(f"== {key}")
            df.show(args.rows, truncate=False)
    if own_session:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
