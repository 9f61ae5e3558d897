"""Summarise the executed (final adaptive) plan of every registered batch query.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def final_tree(text: str) -> str:
    """The operator tree of the final adaptive plan (or the only plan)."""
    tree = text.split("\n\n\n")[0]
    if "== Final Plan ==" in tree:
        tree = tree.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return tree


def summarise(text: str) -> dict:
    tree = final_tree(text)
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct) (\w+)", tree)
    scans = re.findall(r"^\(\d+\) Scan parquet.*?(?:PushedFilters: \[(.*?)\]\n)?ReadSchema: (struct<.*?>)", text, flags=re.M | re.S)
    return {
        "exchanges": len(re.findall(r"(?<![A-Za-z])Exchange \(\d+\)", tree)),
        "reused": len(re.findall(r"ReusedExchange \(\d+\)", tree)),
        "broadcasts": len(re.findall(r"BroadcastExchange \(\d+\)", tree)),
        "joins": sorted({f"{j} {t}" for j, t in joins}),
        "scans": [(p or "-", sch) for p, sch in scans],
        "sort_aggregate": len(re.findall(r"SortAggregate \(\d+\)", tree)),
        "hash_aggregate": len(re.findall(r"(?<![A-Za-z])HashAggregate \(\d+\)", tree)),
    }


def main(argv) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from tillscope.session import local_session

    from tillscope.plans import QUERIES

    spark = local_session(8)
    print(f"# Executed plans at `{os.path.basename(sf_dir)}` (final adaptive plans, local[8])\n")
    print("Generated by `tools/plan_report.py`. Exchanges = shuffles actually run; joins are the strategies AQE chose")
    print("at this size (on a cluster the same plans pick sort-merge where sides are large; skewed partitions are split).\n")
    print("| query | shuffles | reused | broadcasts | sort-agg / hash-agg | joins | scans: pushed filters |")
    print("|---|---|---|---|---|---|---|")
    for name in sorted(QUERIES):
        if name.startswith("sink_"):
            continue
        df = QUERIES[name](spark, sf_dir)
        # Execute this DataFrame's own QueryExecution (a write would plan a
        # separate one) so the explained plan is the final adaptive plan; only
        # a count comes back.
        df._jdf.queryExecution().toRdd().count()
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        s = summarise(text)
        pushed = "; ".join(sorted({p for p, _ in s["scans"]}))
        print(
            f"| {name} | {s['exchanges']} | {s['reused']} | {s['broadcasts']} | {s['sort_aggregate']} / "
            f"{s['hash_aggregate']} | {', '.join(s['joins']) or '-'} | {pushed or '-'} |"
        )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
