"""Physical-plan summary of headline queries (``python -m dispensa.checks.plans``).

For each query: shuffles (``Exchange``), join strategies, windows, sorts,
and every scan's pushed filters and read schema, taken from the executed
plan after running it once (so AQE's runtime choices are visible).
Writes PLANS.md.
"""

from __future__ import annotations

import re
import sys

HEADLINE = ["top_sellers", "sales_by_day", "day_kpis", "purchase_report", "expiry_watch", "sale_detail",
            "ledger_balance", "stock_card", "interaction_hits", "allergy_hits", "admit_sales_snapshot",
            "change_feed", "page_text"]


def summarize(spark, name, fn, sf_dir) -> str:
    df = fn(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan
    # adaptive plans print the final plan first
    m = re.search(r"Final Plan ==(.*?)(\+- == Initial Plan|$)", plan, re.S)
    if m:
        final = m.group(1)
    def count(pat: str) -> int:
        return len(re.findall(pat, final))

    shuffles = count(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)")
    bcast = count(r"BroadcastExchange")
    bhj, smj, shj = count(r"BroadcastHashJoin"), count(r"SortMergeJoin"), count(r"ShuffledHashJoin")
    nlj = count(r"BroadcastNestedLoopJoin|CartesianProduct")
    windows, aggs, topk = count(r"Window \["), count(r"HashAggregate"), count(r"TakeOrderedAndProject")
    lines = [f"### {name}", "",
             f"- shuffles (hash/range/single exchanges): {shuffles}; broadcast exchanges: {bcast}",
             f"- joins: broadcast-hash {bhj}, sort-merge {smj}, shuffled-hash {shj}, nested-loop {nlj}",
             f"- windows: {windows}, hash aggregates: {aggs}, top-k: {topk}"]
    seen = set()
    for line in final.splitlines():
        if "FileScan parquet" not in line:
            continue
        loc = re.search(r"file:([^\],]*)", line)
        pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
        schema = re.search(r"ReadSchema: (struct<.*?>)(?:$|,)", line)
        item = (loc.group(1).rsplit("/", 1)[-1] if loc else "?", pushed.group(1) if pushed else "",
                schema.group(1) if schema else "")
        if item not in seen:
            seen.add(item)
            lines.append(f"- scan `{item[0]}` read `{item[2]}` pushed `{item[1] or '-'}`")
    return "\n".join(lines) + "\n"


def main(argv):
    import os
    sys.path.insert(0, os.getcwd())
    from dispensa.queries import REGISTRY
    from dispensa.session import build_session, ensure_checkpoint_dir
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    # keep scan metadata (pushed filters, read schema) whole in plan strings
    spark = build_session("local[8]", 8, extra={"spark.sql.maxMetadataStringLength": "2000"})
    ensure_checkpoint_dir(spark)
    out = ["# Plans of headline queries", "",
           f"Executed plans (after AQE) at `{sf_dir}` on local[8], written by "
           "`python -m dispensa.checks.plans`.", ""]
    for n in HEADLINE:
        out.append(summarize(spark, n, REGISTRY[n], sf_dir))
    with open("PLANS.md", "w") as f:
        f.write("\n".join(out))
    print("\n".join(out))


if __name__ == "__main__":
    main(sys.argv[1:])
