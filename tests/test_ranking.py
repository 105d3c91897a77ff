"""Literal cases of the ranking library."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.config import EngineConfig, ExposureLogOddsConfig
from skirmish.functions import smoothing
from skirmish.functions import time as times
from skirmish.operators import connectivity, graph, resolve
from skirmish.operators.pagerank import by_joins, power_iteration
from skirmish.plans import engines, fit, queries
from skirmish.sources.schema import prepare, prepared

MATCH = "event_id long, match_id long, winner_id long, loser_id long, completed_at double"
MEMBER = "event_id long, group_id long, entity_id long"


@pytest.fixture(scope="module")
def two(spark):
    """Two components; the second holds six sevenths of the share."""
    matches = spark.createDataFrame([(1, 10, 100, 200, 1.0), (2, 20, 300, 400, 1.0), (2, 21, 300, 400, 1.0), (2, 22, 400, 300, 1.0)], MATCH)
    rosters = spark.createDataFrame([(1, 100, 1), (1, 100, 2), (1, 200, 3), (1, 200, 4), (2, 300, 5), (2, 400, 6)], MEMBER)
    return matches, rosters


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing required columns: match_id, loser_id"):
        prepare("matches", spark.createDataFrame([(1, 2)], "event_id long, winner_id long"))


def test_component_report(two):
    matches, rosters = two
    resolved = resolve.resolve(resolve.weighted_matches(matches, 1.0, 0.0), rosters)
    report = connectivity.analyze(connectivity.components(graph.pair_edges(resolved)), graph.entity_metrics(resolved))
    assert (report.component_count, report.node_count, report.largest_nodes, report.largest_component) == (2, 6, 2, 5)
    assert report.largest_share_fraction == pytest.approx(6 / 7)
    assert report.largest_weight_fraction == pytest.approx(0.6)
    assert "85.7%" in connectivity.message(report, "keep_largest")


def test_policies(two):
    matches, rosters = two
    plain = ExposureLogOddsConfig(use_tick_tock_active=False)
    rank = lambda p: engines.ExposureLogOddsEngine(plain, 1.0).rank_entities(matches, rosters, component_policy=p)
    assert {r["entity_id"] for r in rank("keep_largest").collect()} == {5, 6}
    assert {r["entity_id"] for r in rank("allow").collect()} == {1, 2, 3, 4, 5, 6}
    with pytest.raises(ValueError, match="disconnected"):
        rank("error")
    with pytest.raises(ValueError, match="component_policy"):
        rank("other")


def test_dominance(spark):
    now = 1_700_000_000.0
    matches = spark.createDataFrame([(1, 1, 100, 200, now - 2 * 86400), (1, 2, 100, 300, now - 86400), (1, 3, 200, 300, now)], MATCH)
    rosters = spark.createDataFrame([(1, 100, 1), (1, 100, 2), (1, 200, 3), (1, 200, 4), (1, 300, 5), (1, 300, 6)], MEMBER)
    engine = engines.ExposureLogOddsEngine(now_ts=now)
    s = {r["entity_id"]: r["score"] for r in engine.rank_entities(matches, rosters).collect()}
    assert s[1] > s[3] > s[5] and s[1] == pytest.approx(s[2], abs=1e-6)
    assert engine.last_stage_timings.keys() >= {"pagerank", "total", "graph_build"}


def test_unresolved_side(spark):
    matches = spark.createDataFrame([(1, 1, 100, 200, 1.0)], MATCH)
    with pytest.raises(ValueError, match="Could not resolve winner/loser participants"):
        resolve.resolve(resolve.weighted_matches(matches, 1.0, 0.0), spark.createDataFrame([(1, 100, 1)], MEMBER))


def test_fit_statuses(spark):
    matches = spark.createDataFrame([(999, 1, 10, 11, 1.7e9)], MATCH)
    rosters = spark.createDataFrame([(999, 10, i) for i in (1, 2, 3, 4)] + [(999, 11, i) for i in (5, 6, 7, 8)], MEMBER)
    seen = spark.createDataFrame([(999, 1, 10, 1), (999, 1, 10, 2), (999, 1, 11, 5), (999, 1, 11, 6)], "event_id long, match_id long, group_id long, entity_id long")
    assert fit.assess_dataset_fit(matches, rosters, seen).overall == "good_fit"
    several = rosters.union(spark.createDataFrame([(999, 11, 1)], MEMBER))
    assert fit.assess_dataset_fit(matches, several).overall == "poor_fit"


def test_pagerank_mass_and_tiers(spark):
    rng = np.random.default_rng(1)
    src, dst, w = rng.integers(0, 20, 60), rng.integers(0, 20, 60), rng.random(60)
    t = rng.random(20)
    t /= t.sum()
    r = power_iteration(20, src, dst, w, t, 0.85, 0.0, 10)
    assert r.sum() == pytest.approx(1)
    edges = spark.createDataFrame([("g", int(a), int(b), float(c)) for a, b, c in zip(src, dst, w)], "graph string, src long, dst long, w double")
    nodes = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(t)], "graph string, node long, t double")
    got = {x["node"]: x["rank"] for x in by_joins(edges, nodes, 0.85, 0.0, 10).collect()}
    assert max(abs(got[i] - r[i]) for i in range(20)) < 1e-12


def test_leave_one_out(spark):
    """The effect of a match equals that of solving the graph without it by hand."""
    matches = spark.createDataFrame([(1, 1, 10, 20, 1.0), (1, 2, 10, 30, 1.0), (1, 3, 20, 30, 1.0), (1, 4, 30, 10, 1.0)], MATCH)
    rosters = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], MEMBER)
    engine = engines.ExposureLogOddsEngine(ExposureLogOddsConfig(use_tick_tock_active=False, engine=EngineConfig(score_decay_rate=0.0)), 1.0)
    engine.rank_entities(matches, rosters)
    got = {r["match_id"]: r for r in engine.analyze_entity_matches(1).collect()}
    assert set(got) == {1, 2, 4} and got[1]["is_win"] and not got[4]["is_win"]
    assert got[4]["score_delta"] > 0 > got[1]["score_delta"]
    with pytest.raises(ValueError, match="Unknown variant"):
        engine.analyze_entity_matches(1, variant="x")


def test_smoothing_and_time(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "l double, w double")
    for kind, want in {"none": 2.0, "wins_proportional": 2.06, "constant": 2.000001, "adaptive": 2 + 0.3 / 1.05, "hybrid": 2.030001}.items():
        assert df.select(smoothing.smoothing_strategy(kind)(F.col("l"), F.col("w"))).first()[0] == pytest.approx(want)
    with pytest.raises(ValueError):
        smoothing.smoothing_strategy("other")
    assert times.Clock(0).now == 0
    assert [tuple(r) for r in times.time_windows(spark, 0, 86400.0 * 2.5, 1).collect()] == [(0, 86400), (86400, 172800), (172800, 216000)]
    assert math.isclose(df.select(times.inactivity_decay(F.lit(-1.0), F.lit(0.0), 86400.0 * 40, 30, 0.01)).first()[0], -math.exp(-0.1))


def test_components_of_all_matches(spark, tmp_path):
    """Two islands outside the months and matches that the cut queries read."""
    lines = [(1, 1, 10, 1, 9.0), (1, 2, 20, 2, 5.0), (2, 1, 20, 2, 9.0), (2, 2, 30, 3, 1.0), (3, 1, 40, 7, 8.0), (3, 2, 50, 8, 2.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(i,) for i in (1, 2, 3)], "o_orderkey long").withColumn("o_orderdate", F.to_timestamp_ntz(F.lit("2001-07-05 00:00:00")))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.QUERIES["connected_components"](spark, str(tmp_path)).collect()
    assert {r["id"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    got = queries.QUERIES["component_summary"](spark, str(tmp_path)).collect()
    assert {r["component"]: r["nodes"] for r in got} == {1: 3, 7: 2}


def test_leave_one_out_queries_take_all_matches(spark, tmp_path):
    lines = [x for i in range(1, 13) for x in ((i, 1, 10, 1, 9.0), (i, 2, 20 + i % 3, 2 + i % 3, 5.0))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(i,) for i in range(1, 13)], "o_orderkey long").withColumn("o_orderdate", F.to_timestamp_ntz(F.lit("2001-07-05 00:00:00")))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.QUERIES["loo_neumann"](spark, str(tmp_path)).collect()
    assert sorted(r["match_id"] for r in got) == list(range(1, 13))
