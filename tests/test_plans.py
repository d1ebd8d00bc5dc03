"""Plan-shape guards: no query may plan a Cartesian product or a nested-loop
join, and scans must be pruned and filtered at the source."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF_SMALL

QUERIES = entry_mod.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_leaderboard_scan_is_pruned_and_filtered(spark):
    df = QUERIES["agg7_domain_gap"](spark, SF_SMALL)
    text = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,N)" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>" in text


def test_windows_are_assembled_per_block_not_per_trajectory(spark):
    plan = _plan(QUERIES["win9_sample_windows"](spark, SF_SMALL))
    # the shuffle that builds windows is keyed by (traj, block): a long
    # trajectory is spread over all tasks, and a frame is copied once at most
    assert "hashpartitioning(traj#" in plan and "_blk#" in plan.split("hashpartitioning(traj#", 1)[1][:60]
    assert "sequence(0, 19" not in plan.split("hashpartitioning(traj#", 1)[1]


def test_lineitem_is_reduced_before_the_part_join(spark):
    plan = _plan(QUERIES["agg4_summary_by_resolution"](spark, SF_SMALL))
    # pre-aggregation shuffle on (part, status, flag) below the join with part
    assert "hashpartitioning(l_partkey#" in plan
    assert "partial_sum" in plan
