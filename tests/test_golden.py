"""Golden vectors of the operators' definitions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chainloom.operators import fees, logs, lookup, sinks, traces
from chainloom.operators.audit import islands
from chainloom.sources.chain import Chain


@pytest.mark.parametrize(
    "txs, gas, percentiles, want",
    [([(21000, 0), (21000, 0), (21000, 1000), (21000, 2000)], 84000, (50.0, 75.0), [1000, 2000]), ([(10000, 3000), (20000, 1000), (30000, 4000), (40000, 2000)], 100000, (10.0, 30.0, 60.0, 100.0), [2000, 3000, 3000, 4000])],
)
def test_fee_rewards(spark, txs, gas, percentiles, want):
    df = spark.createDataFrame([(1, i, g, t, gas) for i, (g, t) in enumerate(txs)], "block_number long, tx_index long, gas long, tip long, block_gas long")
    assert [r.reward for r in fees.rewards(df, percentiles).orderBy("p").collect()] == want


def test_trace_addresses(spark):
    class Fixed(Chain):
        traces = spark.createDataFrame([(1, i, d, 0, "Call", 1, 2) for i, d in enumerate([0, 1, 2, 2, 1, 2, 3, 1])], "tx_id long, pos long, depth long, status int, kind string, from_addr long, to_addr long")

    got = traces.addressed(Fixed(spark, "")).orderBy("pos").collect()
    assert [r.address for r in got] == [[], [0], [0, 0], [0, 1], [1], [1, 0], [1, 0, 0], [2]]
    parents = traces.call_tree_parent(Fixed(spark, "")).orderBy("pos").collect()
    assert [r.parent for r in parents] == [None, 0, 1, 1, 0, 4, 5, 0]


@pytest.mark.parametrize("numbers", [[], [1], [1, 2, 3], [1, 2, 3, 5, 6, 10], [998, 999, 1000, 1001, 2000]])
def test_ranges_collapse_and_expand(spark, numbers):
    got = islands(spark.createDataFrame([("a", n) for n in numbers], "p string, n long"), "p").orderBy("lo").collect()
    assert [n for r in got for n in range(r.lo, r.hi + 1)] == numbers
    assert all(b.lo > a.hi + 1 for a, b in zip(got, got[1:]))


def test_range_limits():
    assert logs.resolve_range(10, 10, 99, 1) == (10, 10) and logs.resolve_range(0, 1000, 500) == (0, 500) and logs.resolve_range(0, 1000, 5000) == (0, 1000)
    for bad in ((5, 4, 9), (0, 1001, 5000), (10, 12, 9)):
        with pytest.raises(logs.RangeError):
            logs.resolve_range(*bad)


def test_breaker(spark):
    """Open after two failures in a row; a success while open changes nothing; after the time-out one success closes it, one failure opens it again."""
    b = sinks.Breaker(2, 10)
    assert [b.call(t, bad) for t, bad in [(0, True), (1, False), (2, True), (3, True), (4, False), (12, True), (13, True), (14, False), (23, False), (24, True), (25, True), (40, False)]] == [
        "closed", "closed", "closed", "open", "open", "open", "open", "open", "closed", "closed", "open", "closed"]
    calls = [(s, datetime(2024, 1, 1, h), h, True) for s in (1, 2) for h in range(3)]
    got = sinks.breaker_states(spark.createDataFrame(calls, "source long, ts timestamp, event_id long, bad boolean"), 2, "1 hour").collect()
    assert sorted((r.source, r.event_id, r.state) for r in got) == [(s, h, ["closed", "open", "open"][h]) for s in (1, 2) for h in range(3)]


def test_fee_history_limits():
    fees.check_history(1024, [0, 50, 100])
    for bad in ((1025, []), (1, [50, 10]), (1, [101]), (1, [-1]), (1, range(101))):
        with pytest.raises(ValueError):
            fees.check_history(*bad)


def test_as_of_without_earlier_row(spark):
    events = spark.createDataFrame([("a", 5, 1), ("a", 9, 2)], "k string, t long, v int")
    asked = spark.createDataFrame([("a", 4), ("a", 5), ("a", 8), ("a", 99), ("b", 9)], "k string, q long")
    got = {(r.k, r.q): r.v for r in lookup.as_of(events, "t", asked, "q", "k", ["v"]).collect()}
    assert got == {("a", 4): None, ("a", 5): 1, ("a", 8): 1, ("a", 99): 2, ("b", 9): None}


def test_range_predicates_reach_the_scan(spark):
    plan = logs.get_logs_bloom_pruned(Chain(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), GreaterThanOrEqual(l_orderkey,100), LessThanOrEqual(l_orderkey,4009)]" in plan and "CartesianProduct" not in plan
