"""Report physical plans with nested-loop joins, cross products, row-at-a-time Python, or windows over one partition.

Command line: python -m tests.plan_scan SF [name ...].
"""

from __future__ import annotations

import re
import sys

SIGNS = {
    "nested loop": r"BroadcastNestedLoopJoin",
    "cross product": r"CartesianProduct",
    "row python": r"BatchEvalPython",
    "single-partition window": r"Window [^\n]*\], \[[^\n]*\]\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition",
}


def flags(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name, pattern in SIGNS.items() if re.search(pattern, plan)]


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from attesta.session import build_session

    spark = build_session("plans", master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    found = 0
    for name, build in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        seen = flags(build(spark, f"/root/testdata/sf{argv[0]}"))
        found += bool(seen)
        if seen:
            print(name, seen, flush=True)
    print(f"{found} flagged")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
