"""Print the physical plans of representative steps as Markdown (PLANS.md).

    python tools/show_plans.py /root/testdata/sf0.01 > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rosterlens.operators import latest_snapshot  # noqa: E402
from rosterlens.plans import ANALYSES, workforce  # noqa: E402
from rosterlens.session import build_session  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rosterlens.sources import panel_from_frames, panel_from_tables  # noqa: E402

STEPS = [
    ("q1_1_flow", "Yearly flow in one pass: each row yields its hire and (real) termination event, one distinct (partial de-duplication before the shuffle), conditional counts per year, running total over one row per year."),
    ("q5_6_city_long", "Threshold report over the persisted terminated base: the P99 is a scalar subquery (partial/final percentile), the filter runs on every partition."),
    ("q4_1_top20_job", "Top 20% of titles: the P80 is a window over the one-row-per-title count table, so the distinct count runs once."),
    ("q2_4_age_box", "Box statistics: rows folded into a (group, age) histogram; quartiles from the histogram with frequencies; whiskers from the histogram joined to the per-group quartiles."),
    ("q3_4_top_dept", "Top member per reason: row_number over the small count table, planned with WindowGroupLimit."),
]


def _plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    out, skip = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None:
            if depth > skip:
                continue
            skip = None
        if "InMemoryRelation" in line:
            out.append(line.split("InMemoryRelation")[0] + "InMemoryRelation <persisted shared base>")
            skip = depth
            continue
        out.append(re.sub(r"#\d+L?", "", line)[:180])
    return "\n".join(out)


def main(sf_dir: str) -> None:
    spark = build_session(master="local[8]", shuffle_partitions=8)
    print("# Physical plans of representative steps\n")
    print(f"Generated by `tools/show_plans.py` on `{sf_dir}` (Spark {spark.version}, AQE on). Expression ids removed;")
    print("sub-plans of persisted shared bases are elided. Plans are the ones Spark chose before execution.\n")

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    print("## Panel derivation with automatic broadcasts off (as at 100 TB)\n")
    print("`nation` is still broadcast after its bounded row check. Orders of non-hot customers are shuffled once")
    print("(`REPARTITION_BY_COL` on `o_custkey`) and sorted once; one `Window` computes min/max record date and the")
    print("latest-order `row_number`, and the sort-merge join to the customer row takes that output with no further")
    print("sort. Hot customers (none at this size) go through broadcast semi joins, a partial `SortAggregate` and a")
    print("broadcast join; the hot key set is a checkpointed table (`Scan ExistingRDD`).\n")
    print("```\n" + _plan(panel_from_tables(spark, sf_dir)) + "\n```\n")
    print("## Panel derivation with one customer owning a third of the orders\n")
    print("Same settings; `orders` rewritten so that every third order belongs to customer 1, and the hot")
    print("thresholds scaled to the test size (`hot_min_rows=2000`, `sample_fraction=0.5`). Customer 1 is")
    print("found hot: its orders are taken by a broadcast semi join, aggregated with a partial")
    print("`SortAggregate` and joined back by broadcast; all other orders take the shuffled window route.\n")
    skew_dir = tempfile.mkdtemp(prefix="rosterlens-plans-")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    hot_orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")))
    hot_orders.write.parquet(f"{skew_dir}/orders.parquet")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    skewed = panel_from_frames(
        spark.read.parquet(f"{skew_dir}/orders.parquet"), read("customer"), read("nation"),
        hot_min_rows=2000, sample_fraction=0.5,
    )
    print("```\n" + _plan(skewed) + "\n```\n")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")

    w = workforce(spark, sf_dir)
    print("## Latest snapshot per employee (W2), persisted base of Q5/Q6\n")
    print("Partial `WindowGroupLimit` before the shuffle by `EmployeeID`: one row per employee per map task.\n")
    print("```\n" + _plan(latest_snapshot(w.panel)) + "\n```\n")
    for key, note in STEPS:
        print(f"## `{key}`\n\n{note}\n")
        print("```\n" + _plan(ANALYSES[key](w)) + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
