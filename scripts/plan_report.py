"""Physical-plan summary of every registered campaign query over stored tables
(production layout) with broadcast joins off, as where no side is small:
shuffles, join strategies, top-k/window operators and filters pushed into the
scans. ``python scripts/plan_report.py [sf_dir]`` prints a markdown table."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from campaignlab.plans import load_all  # noqa: E402
from campaignlab.session import ensure_checkpoint_dir, local_session  # noqa: E402
from campaignlab.sources.fixtures import StoredTestData, TestData  # noqa: E402
from campaignlab.sources.tables import save_tables  # noqa: E402


def summary(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    txt = buf.getvalue()
    tree = txt.split("\n\n")[0]
    count = lambda pat: len(re.findall(pat, tree))
    pushed = set()
    for m in re.findall(r"PushedFilters: \[(.*)\]", txt):
        for f in re.split(r", (?=[A-Z][A-Za-z]*\()", m):
            if not f.startswith("IsNotNull"):
                pushed.add(f)
    return {
        "exchanges": count(r"\bExchange \("),
        "broadcast_joins": count(r"BroadcastHashJoin"),
        "sort_merge_joins": count(r"SortMergeJoin"),
        "partial_aggs": count(r"HashAggregate|ObjectHashAggregate|SortAggregate"),
        "topk": count(r"TakeOrderedAndProject|WindowGroupLimit"),
        "pushed": "; ".join(sorted(pushed)),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = f"{ensure_checkpoint_dir(spark).rstrip('/')}/plans-{uuid.uuid4()}"
    save_tables(TestData(spark, sf_dir).campaign, tables, partition_facts=False)
    print("| query | exchanges | broadcast joins | sort-merge joins | aggregates | top-k / group limit | pushed filters |")
    print("|---|---|---|---|---|---|---|")
    for name, spec in load_all().items():
        s = summary(spec.build(StoredTestData(spark, sf_dir, tables)))  # explained, not run
        print(f"| {name} | {s['exchanges']} | {s['broadcast_joins']} | {s['sort_merge_joins']} | "
              f"{s['partial_aggs']} | {s['topk']} | {s['pushed']} |")


if __name__ == "__main__":
    main()
