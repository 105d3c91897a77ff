"""What keeps the ranking library's work and memory in bounds as its tables grow."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skirmish.config import DecayConfig, TickTockConfig
from skirmish.operators import blocks, resolve
from skirmish.operators.pagerank import by_arrays, by_blocks, by_joins, pagerank
from skirmish.plans import engines, loo
from skirmish.sources.tables import competition

MATCH = "event_id long, match_id long, winner_id long, loser_id long, completed_at double"
SEEN = "event_id long, match_id long, group_id long, entity_id long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def flows(spark):
    """Two graphs with nodes without outgoing weight and edges of unknown nodes."""
    rng = np.random.default_rng(1)
    e = pd.DataFrame({"graph": np.where(np.arange(600) % 3 == 0, "a", "b"), "src": rng.integers(0, 30, 600), "dst": rng.integers(5, 45, 600), "w": rng.random(600)})
    t = rng.random(40)
    v = pd.concat([pd.DataFrame({"graph": g, "node": np.arange(40), "t": t / t.sum()}) for g in "ab"])
    return spark.createDataFrame(e), spark.createDataFrame(v)


def ranks(df):
    return df.toPandas().sort_values(["graph", "node"])["rank"].to_numpy()


@pytest.mark.parametrize(("tol", "steps"), [(0.0, 7), (1e-9, 100)])
def test_pagerank_by_blocks(flows, monkeypatch, tol, steps):
    monkeypatch.setattr(blocks, "CHUNK", 50)
    want = ranks(by_arrays(*flows, 0.85, tol, steps))
    assert np.abs(ranks(by_blocks(*flows, 0.85, tol, steps)) - want).max() < 1e-15
    assert np.abs(ranks(pagerank(*flows, 0.85, tol, steps, array_edges=10)) - want).max() < 1e-15


def test_pagerank_by_joins(flows):
    e, v = flows[0].where("dst < 40"), flows[1]
    assert np.abs(ranks(by_joins(e, v, 0.85, 0.0, 3)) - ranks(by_arrays(e, v, 0.85, 0.0, 3))).max() < 1e-15


@pytest.fixture
def tables(spark, tmp_path):
    lines = [(1, 1, 10, 1, 9.0), (1, 2, 20, 2, 5.0), (1, 3, 20, 4, 5.0), (2, 1, 20, 2, 9.0), (2, 2, 30, 3, 9.0), (3, 1, 40, 7, 8.0), (3, 2, 40, 8, 2.0), (4, 1, 10, 1, None), (4, 2, 20, 2, 1.0), (4, 3, 30, 3, 2.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "o_orderkey long").withColumn("o_orderdate", F.to_timestamp_ntz(F.lit("2001-07-05 00:00:00")))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    return competition(spark, str(tmp_path))


def test_competition_sorts_no_windows(tables):
    """Ends of equal prices by line, those without a price last among the high and first among the low."""
    got = {r["match_id"]: (r["winner_id"], r["loser_id"]) for r in tables.matches.collect()}
    assert got == {1: (10, 20), 4: (30, 10)}
    assert "Window" not in plan(tables.matches)
    assert sorted(tuple(r) for r in tables.appearances.select("match_id", "group_id", "entity_id").collect()) == [(1, 10, 1), (1, 20, 2), (1, 20, 4), (4, 10, 1), (4, 20, 2), (4, 30, 3)]
    assert "row_number" not in plan(tables.appearances)


def test_rosters_are_read_only_where_appearances_lack(spark):
    matches = spark.createDataFrame([(1, 1, 10, 20, 1.0), (1, 2, 10, 30, 1.0), (2, 1, 10, 20, 1.0)], MATCH)
    weighted = resolve.weighted_matches(matches, 1.0, 0.0)
    rosters = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3), (1, 30, 4), (2, 10, 5), (2, 20, 6)], "event_id long, group_id long, entity_id long")
    some = [(1, 1, 10, 1), (1, 1, 20, 2), (1, 1, 30, 3), (1, 2, 10, 1), (2, 1, 10, 6), (2, 1, 20, 5)]
    got = resolve.resolve(weighted, rosters, spark.createDataFrame(some, SEEN))
    assert {(r["event_id"], r["match_id"]): (r["winners"], r["losers"], r["share"]) for r in got.collect()} == {(1, 1): ([1], [2], 1.0), (1, 2): ([1], [3, 4], 0.5), (2, 1): ([6], [5], 1.0)}
    broken = rosters.where(F.raise_error("rosters were read").isNull())
    whole = resolve.resolve(weighted, broken, spark.createDataFrame([*some, (1, 2, 30, 9)], SEEN))
    assert whole.count() == 3
    with pytest.raises(ValueError, match="Could not infer group_id"):
        resolve.resolve(weighted, rosters, spark.createDataFrame([*some, (1, 2, None, 9)], SEEN))


@pytest.mark.parametrize("name", ["rosters", "appearances", "log-odds", "rows"])
def test_engines_make_no_pairs_of_large_graphs(spark, monkeypatch, name):
    """Many pairs give what few give, and no pair edges are made of rosters."""
    rng = np.random.default_rng(2)
    rosters = [(e, g, int(i)) for e in (1, 2, 3) for g in range(8) for i in rng.choice(30, 4, replace=False)] + [(1, 9, 40), (1, 0, None)]
    games = [(int(e), k, int(a), int(b), float(rng.integers(0, 9)) * 86400) for k, (e, (a, b)) in enumerate(zip(rng.integers(1, 4, 40), (rng.choice(8, 2, replace=False) for _ in range(40)), strict=True))]
    seen = [(e, k, g, i) for e, k, a, b, _ in games for g in (a, b) for e2, g2, i in rosters if (e2, g2) == (e, g) and i is not None and i % 3]
    decay, config = DecayConfig(5.0), TickTockConfig(decay=DecayConfig(5.0), max_ticks=3)
    matches, members = spark.createDataFrame(games, MATCH), spark.createDataFrame(rosters, "event_id long, group_id long, entity_id long")
    backend = {"log-odds": engines.LogOddsBackend, "rows": engines.RowPageRankBackend}.get(name)
    engine = lambda: engines.TTLEngine(config, backend(decay=decay), 9e5) if backend else engines.TickTockEngine(config, 9e5)
    more = (spark.createDataFrame(seen, SEEN),) if name == "appearances" else ()
    rank = lambda: engine().rank_entities(matches, members, *more).toPandas().sort_values("entity_id").reset_index(drop=True)
    want = rank()
    monkeypatch.setattr(engines, "ARRAY_EDGES", 10)
    if name != "appearances":
        monkeypatch.setattr(engines.graph, "pairs", None)
    got = rank()
    assert set(got["entity_id"]) == set(want["entity_id"])
    for c in set(want.columns) - {"entity_id", "active"}:
        assert np.abs(got[c] - want[c]).max() < 1e-10


def test_leaving_out_is_a_product_less_a_match(monkeypatch):
    """Against dense matrices, with a column that the match empties and one that was empty."""
    monkeypatch.setattr(loo, "SLICE", 3)
    winner, loser, share = np.array([0, 0, 1, 2, 3, 1]), np.array([1, 2, 2, 3, 1, 4]), np.array([0.5, 0.25, 1.0, 0.75, 0.5, 0.3])
    rho, alpha, n = np.array([0.3, 0.25, 0.2, 0.1, 0.1, 0.05]), 0.85, 6

    def dense(src, dst, w, t, fill):
        a = np.zeros((n, n))
        np.add.at(a, (dst, src), w)
        sums = a.sum(0)
        return np.column_stack([a[:, j] / sums[j] if sums[j] > 1e-12 else fill(j) for j in range(n)])

    ends = {"win": (loser, winner), "loss": (winner, loser)}
    solve = lambda a, t: np.linalg.solve(np.eye(n) - alpha * a, (1 - alpha) * t)
    ranks = {g: solve(dense(*e, share, rho, lambda j: rho), rho) for g, e in ends.items()}
    graphs = loo.Graphs(np.arange(n), rho, ranks, winner, loser, share, 6.6, alpha, 0.1)
    win, loss, new = graphs.without(np.array([1]), np.array([4]), 0.3, 0)
    had = {g: np.bincount(e[0], share, n) > 0 for g, e in ends.items()}
    for g, got in (("win", win), ("loss", loss)):
        want = solve(dense(*ends[g], share - np.array([0, 0, 0, 0, 0, 0.3]), new, lambda j, g=g: new if had[g][j] else rho), new)
        assert np.abs(got - want).max() < 1e-11
