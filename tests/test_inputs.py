"""Public conversions, missing times, the single-match analysis and comparison, numbering, generators, logs."""
import logging

import pytest
from pyspark.sql import functions as F

from skirmish import config, logs
from skirmish.config import DecayConfig, EngineConfig, ExposureLogOddsConfig, TickTockConfig
from skirmish.operators import resolve
from skirmish.operators.numbering import numbered
from skirmish.plans import engines, inputs, loo
from skirmish.sources import generate, schema

NOW = 1_700_000_000.0
DAY = 86_400.0


@pytest.fixture(scope="module")
def league(spark):
    matches = [(1, 1, 10, 20, NOW - 5 * DAY), (1, 2, 20, 30, NOW - 4 * DAY), (1, 3, 30, 10, None), (2, 1, 10, 30, NOW - DAY), (2, 2, 20, 10, NOW - 2 * DAY)]
    members = [(e, g, g * 10 + k) for e in (1, 2) for g in (10, 20, 30) for k in (0, 1)]
    return spark.createDataFrame(matches, "event_id long, match_id long, winner_id long, loser_id long, completed_at double"), spark.createDataFrame(members, "event_id long, group_id long, entity_id long")


def test_missing_times(league):
    matches, members = league
    get = lambda df: {(r["loser_id"], r["winner_id"]): r["weight_sum"] for r in df.collect()}
    now, then = get(inputs.player_edges(matches, members, {}, NOW, 0.01)), get(inputs.player_edges(matches, members, {1: 1.0}, NOW, 0.01))
    assert now[100, 300] == pytest.approx(1.0) and then[100, 300] < 1e-80
    assert get(inputs.team_edges(matches, {1: 2.0}, NOW, 0.0, 1.0))[20, 10] == pytest.approx(2.0)
    # the tick-tock engine's events always have an influence, so a match without a time weighs next to nothing
    engine = engines.TickTockEngine(TickTockConfig(decay=DecayConfig(1.0), teleport_mode="uniform"), NOW)
    missing = {r["entity_id"]: r["score"] for r in engine.rank_entities(matches, members).collect()}
    without = {r["entity_id"]: r["score"] for r in engine.rank_entities(matches.where("completed_at IS NOT NULL"), members).collect()}
    assert missing == pytest.approx(without, rel=1e-6)


def test_conversion_and_older_names(league):
    matches, members = league
    ours = inputs.convert_matches(matches, members, None, NOW, 0.01)
    assert ours.count() == 5 and "share" not in inputs.convert_matches(matches, members, None, NOW, 0.01, share=False).columns
    older = schema.prepared(matches, members, older=True)
    assert "tournament_id" in older.matches.columns and "user_id" in older.participants.columns
    again = inputs.convert_matches(older.matches, older.participants, None, NOW, 0.01)
    assert {tuple(r) for r in again.select("match_id", "share").collect()} == {tuple(r) for r in ours.select("match_id", "share").collect()}
    with pytest.raises(ValueError, match="missing required columns: winner_id"):
        schema.prepared(matches.drop("winner_id"), members)
    with pytest.raises(ValueError, match="columns not found: winners"):
        inputs.node_mapping(matches.withColumnRenamed("loser_id", "losers"))
    assert inputs.factorize_ids([3, 1, 3, 2]) == ([3, 1, 2], {3: 0, 1: 1, 2: 2})
    assert [r["idx"] for r in inputs.node_mapping(ours).orderBy("id").collect()] == list(range(6))


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    got = {r["x"]: r["idx"] for r in numbered(df, F.desc("x")).collect()}
    assert got == {x: i for i, x in enumerate(sorted((i * 7919 % 1009 for i in range(1000)), reverse=True))}
    assert numbered(df.limit(0), "x").count() == 0


def test_single_match_analysis(league):
    matches, members = league
    engine = engines.ExposureLogOddsEngine(ExposureLogOddsConfig(engine=EngineConfig(score_decay_rate=0.0), use_tick_tock_active=False), NOW)
    with pytest.raises(ValueError, match="must be called first"):
        engine.prepare_loo_analyzer()
    engine.rank_entities(matches, members)
    kept = engine.prepare_loo_analyzer()
    assert engine.prepare_loo_analyzer() is kept and engine.prepare_loo_analyzer(force_rebuild=True) is not kept
    rows = engine.analyze_entity_matches(100)
    # both events have matches 1 and 2; each counts for itself
    assert rows.count() == 4
    one = engine.analyze_match_impact(3, 100)
    assert one["is_win"] is False and one["score_delta"] == pytest.approx(rows.where("match_id = 3").first()["score_delta"])
    assert engine.analyze_match_impact(99, 100)["score_delta"] == 0.0
    same = loo.compare_variants(rows.where("match_id = 3"), rows.where("match_id = 3"))
    assert same["top_overlap"] == 1.0 and same["score_delta_mae"] == 0.0 and same["score_delta_spearman"] is None
    assert loo.compare_variants(rows, rows.limit(0))["top_overlap"] is None


def test_generated_tables(spark):
    t = generate.synthetic(spark, 3, 5, 40, 4, 7)
    assert t.matches.count() == 120 and t.participants.count() == 60 and t.matches.where("winner_id = loser_id").count() == 0
    known = t.participants.select("event_id", F.col("group_id").alias("winner_id")).distinct()
    assert t.matches.join(known, ["event_id", "winner_id"], "left_anti").count() == 0
    assert sorted(t.matches.collect()) == sorted(generate.synthetic(spark, 3, 5, 40, 4, 7).matches.collect())
    events = spark.createDataFrame([(True, 8, 32, 20, "Cup"), (True, 8, 32, 20, "Practice cup"), (True, 2, 32, 20, "Small"), (False, 8, 32, 20, "Free"), (None, 8, 32, 20, "X")], "is_ranked boolean, team_count int, participated_users_count int, match_count int, name string")
    assert [generate.quality_events(events, m).count() for m in ("none", "ranked_only", "ranked_quality")] == [5, 3, 1]


def test_settings_and_logs(caplog):
    assert config.merge_configs({"a": 1}, {"b": 2}, {"a": 3}) == {"a": 3, "b": 2} and config.merge_configs() == {}
    logger = logging.getLogger("skirmish-test")
    with caplog.at_level(logging.INFO, "skirmish-test"):
        with logs.timed(logger, "step"):
            pass
        with pytest.raises(KeyError), logs.timed(logger, "other"):
            raise KeyError
        logs.convergence(logger, 3, 0.1, 0.2)
    assert "step took" in caplog.text and "other failed" in caplog.text and "converged at step 3" in caplog.text


def test_competitive_with_byes(spark):
    df = spark.createDataFrame([(1, 1, 2, None), (2, 1, None, False), (3, 1, 2, True), (4, 2, 1, False)], "match_id int, winner_id int, loser_id int, walkover boolean")
    assert [r["match_id"] for r in resolve.competitive(df).orderBy("match_id").collect()] == [1, 4]
