"""Summarise the physical plan of every registered query.

Usage: python scripts/plan_report.py [sf_dir] > docs/PLANS.md

Per query: shuffles, join strategies, scans with their read schema and pushed
filters, and any operator that would not scale (Cartesian product, nested-loop
join, Python evaluation).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import evlog.session  # noqa: E402
from evlog.plans.queries import BATCH_QUERIES  # noqa: E402
from evlog.session import get_session  # noqa: E402
from evlog.streaming.queries import STREAM_QUERIES  # noqa: E402

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
       "MapInPandas")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def summarise(text: str) -> dict:
    ops = re.findall(r"[+:\- ]*([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*) \(\d+\)", text)
    return {
        "exchanges": len(re.findall(r"\bExchange \(\d+\)", text)),
        "joins": sorted({o for o in ops if o.endswith("Join") or "Join " in o}),
        "read_schema": sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", text))),
        "pushed": sorted(set(p for p in re.findall(r"PushedFilters: \[([^\n]*)\]", text) if p)),
        "bad": sorted({b for b in BAD if b in text}),
        "checkpointed_inputs": text.count("Scan ExistingRDD"),
    }


def recorded_plans(fn, spark, sf_dir) -> str:
    """The plans of a query and of everything it checkpoints on the way."""
    import evlog.operators.counts
    import evlog.operators.ledger
    import evlog.plans.joins
    import evlog.plans.queries
    import evlog.streaming.live
    import evlog.streaming.sinks

    modules = [evlog.operators.counts, evlog.operators.ledger, evlog.plans.joins, evlog.plans.queries, evlog.streaming.live, evlog.streaming.sinks]
    texts, keep = [], evlog.session.materialize

    def record(df):
        texts.append(plan_text(df))
        return keep(df)

    for module in modules:
        module.materialize = record
    try:
        texts.append(plan_text(fn(spark, sf_dir)))
    finally:
        for module in modules:
            module.materialize = keep
    return "\n".join(texts)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/plan_report.py {sf_dir}`. Plans that end in a `checkpoint()` count too. Stream and sink")
    print("queries are planned as the batch read of what their sink wrote; of the live ones each batch's checkpoints count. Events are scanned once for each scan listed.")
    print("`sequence_gaps` and `non_empty` read the payload columns because an empty body counts as missing, as in the reference.\n")
    print("| query | shuffles | joins | scans of a stored table | columns read | pushed filters | not scalable |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in {**BATCH_QUERIES, **STREAM_QUERIES}.items():
        text = recorded_plans(fn, spark, sf_dir)
        s = summarise(text)
        schema = "<br>".join(s["read_schema"]) or "—"
        pushed = "<br>".join(s["pushed"]) or "—"
        joins = ", ".join(s["joins"]) or "—"
        scans = len(re.findall(r"\bScan parquet\s+\(\d+\)\nOutput", text)) or len(re.findall(r"ReadSchema:", text))
        print(f"| {name} | {s['exchanges']} | {joins} | {scans} | {schema} | {pushed} | {', '.join(s['bad']) or 'none'} |")
    spark.stop()


if __name__ == "__main__":
    main()
