"""Plan guards: no registered query may contain an operator that does not scale,
and scans must read only the columns a query needs."""

from __future__ import annotations

import os
import sys

import pytest
from conftest import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from plan_report import BAD, plan_text, summarise  # noqa: E402

from evlog.plans.queries import BATCH_QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(BATCH_QUERIES))
def test_no_unscalable_operator(spark, name):
    text = plan_text(E.queries()[name](spark, SMALL))
    assert not [b for b in BAD if b in text], text


@pytest.mark.parametrize("name, allowed", [
    ("end_positions", {"event_id", "user_id"}),
    ("start_from_offset", {"event_id", "user_id"}),
    ("slice_ranges", {"event_id", "user_id"}),
    ("one_partition", {"event_id", "ts", "user_id"}),
])
def test_scans_are_pruned(spark, name, allowed):
    s = summarise(plan_text(E.queries()[name](spark, SMALL)))
    assert s["read_schema"]
    for schema in s["read_schema"]:
        cols = {part.split(":")[0] for part in schema[len("struct<"):-1].split(",")}
        assert cols <= allowed, schema


def test_start_bounds_reach_the_scan(spark):
    off = summarise(plan_text(E.queries()["start_from_offset"](spark, SMALL)))
    assert any("GreaterThan(event_id" in p for p in off["pushed"])
    tim = summarise(plan_text(E.queries()["start_from_time"](spark, SMALL)))
    assert any("GreaterThanOrEqual(ts" in p for p in tim["pushed"])


def test_small_sides_are_broadcast(spark):
    for name in ("start_from_checkpoint", "slice_ranges", "partition_lag"):
        s = summarise(plan_text(E.queries()[name](spark, SMALL)))
        assert s["joins"] and all(j.startswith("BroadcastHashJoin") for j in s["joins"]), (name, s["joins"])


def test_position_bounds_reach_the_scan(spark):
    found = {name: summarise(plan_text(E.queries()[name](spark, SMALL)))["pushed"]
             for name in ("start_from_checkpoint", "slice_ranges", "slice_ranges_per_hub")}
    assert all(any("GreaterThan(event_id" in p for p in pushed) for pushed in found.values()), found
    assert all(any("LessThanOrEqual(event_id" in p for p in found[n]) for n in ("slice_ranges", "slice_ranges_per_hub")), found


@pytest.mark.parametrize("name", ["ledger_rows", "sequence_gaps", "window_counts"])
def test_events_are_scanned_once(spark, monkeypatch, name):
    """Counts the scans of all plans of the operator, the ones that end in a checkpoint too."""
    from evlog.operators import counts, ledger
    from evlog.plans import queries as Q

    plans = []

    def recorded(df, keep=counts.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    for module in (counts, ledger):
        monkeypatch.setattr(module, "materialize", recorded)
    env = Q.events(spark, SMALL)
    out = {"ledger_rows": lambda: ledger.ledger_rows(env, Q.hour(), "u"), "sequence_gaps": lambda: counts.sequence_gaps(env, Q.hour()),
           "window_counts": lambda: counts.window_counts(env, 60)}[name]()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    scans = [line for p in plans for line in p.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 1
    if name == "window_counts":
        assert "ReadSchema: struct<ts:timestamp_ntz>" in scans[0]


def test_unions_read_only_their_folders(spark):
    from evlog.plans import queries as Q

    for name, inputs in (("union_partitions", Q.PARTITIONS), ("union_hubs", len(Q.HUB_PARTITIONS))):
        text = Q.BATCH_QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        filters = [line for line in text.splitlines() if "FileScan parquet" in line]
        assert len(filters) == inputs and all("PartitionFilters: [isnotnull(" in line for line in filters)
