"""Each operator as a query over the driver's tables, and SQL that gives the same rows."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.config import DecayConfig, EngineConfig, ExposureLogOddsConfig, PageRankConfig, TickTockConfig
from skirmish.functions import smoothing, teleport
from skirmish.functions import time as times
from skirmish.operators import connectivity, graph, influence, resolve, scoring
from skirmish.operators.pagerank import pagerank
from skirmish.plans import engines, fit, inputs, loo
from skirmish.plans.results import RankResult
from skirmish.session import cut
from skirmish.sources.schema import RankInputs, prepared
from skirmish.sources.tables import HALF_LIFE, NOW, competition

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RATE = math.log(2) / HALF_LIFE
STEPS = 8

BASE = f"""
li AS (SELECT l_orderkey AS match_id, l_linenumber AS line, l_suppkey AS group_id, l_partkey AS entity_id, l_extendedprice AS price, year(o_orderdate) * 100 + month(o_orderdate) AS event_id, epoch(o_orderdate)::DOUBLE AS completed_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY price DESC, line, entity_id, group_id) AS hi, row_number() OVER (PARTITION BY match_id ORDER BY price, line, entity_id, group_id) AS lo FROM li),
m AS (SELECT * FROM (SELECT event_id, match_id, completed_at, max(CASE WHEN hi = 1 THEN group_id END) AS winner_id, max(CASE WHEN lo = 1 THEN group_id END) AS loser_id FROM r GROUP BY ALL) WHERE winner_id <> loser_id),
pa AS (SELECT DISTINCT event_id, group_id, entity_id FROM li),
ap AS (SELECT DISTINCT event_id, match_id, group_id, entity_id FROM li SEMI JOIN m USING (match_id)),
wm AS (SELECT *, completed_at AS ts, exp(-{RATE!r} * ({NOW} - completed_at) / 86400.0) AS weight FROM m),
wg AS (SELECT wm.match_id, wm.event_id, wm.weight, wm.ts, list(DISTINCT w.entity_id ORDER BY w.entity_id) AS winners FROM wm JOIN ap w ON w.match_id = wm.match_id AND w.group_id = wm.winner_id GROUP BY ALL),
lg AS (SELECT wm.match_id, list(DISTINCT l.entity_id ORDER BY l.entity_id) AS losers FROM wm JOIN ap l ON l.match_id = wm.match_id AND l.group_id = wm.loser_id GROUP BY ALL),
rs AS (SELECT wg.*, losers, len(winners) AS winner_count, len(losers) AS loser_count, weight / (len(winners) * len(losers)) AS share FROM wg JOIN lg USING (match_id)),
mem AS (SELECT match_id, event_id, share, weight, ts, unnest(winners || losers) AS id FROM rs),
em AS (SELECT id, sum(share) AS share, sum(weight) AS weight, max(ts) AS ts FROM mem GROUP BY id),
x2 AS (SELECT event_id, w AS winner_id, l AS loser_id, share, weight FROM rs, unnest(winners) t(w), unnest(losers) u(l)),
pe AS (SELECT winner_id, loser_id, sum(share) AS share FROM x2 GROUP BY ALL),
re AS (SELECT loser_id, winner_id, sum(weight) AS weight_sum FROM x2 GROUP BY ALL),
ls AS (SELECT loser_id AS node, sum(weight_sum) AS loss FROM re GROUP BY ALL), ws AS (SELECT winner_id AS node, sum(weight_sum) AS win FROM re GROUP BY ALL),
dn AS (SELECT node, loss, coalesce(win, 0) AS win FROM ls LEFT JOIN ws USING (node)),
nd AS (SELECT id AS node FROM em), n AS (SELECT count(*)::DOUBLE AS n FROM nd),
rho AS (SELECT id AS node, (share + 1e-12) / sum(share + 1e-12) OVER () AS t FROM em),
mb AS (SELECT DISTINCT event_id, id FROM mem),
sc AS (SELECT id, weight / (1 + share) AS score FROM em),
pl AS (SELECT event_id, id, score, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, id) AS place FROM mb JOIN sc USING (id))
"""


def _sql(body: str, recursive: str = "") -> str:
    return "WITH RECURSIVE " + BASE.strip() + (", " + recursive if recursive else "") + " " + body




def data(spark: SparkSession, sf_dir: str, resolved: bool = True) -> tuple[RankInputs, DataFrame, DataFrame | None]:
    """Inputs, weighted and resolved matches."""
    tables = competition(spark, sf_dir)
    weighted = resolve.weighted_matches(tables.matches, NOW, RATE)
    return tables, weighted, resolve.resolve(weighted, tables.participants, tables.appearances, check=False) if resolved else None


def query(name: str, sql: str | None = None, resolved: bool = True) -> Callable:
    """Registers a function of what ``data`` gives; without ``resolved`` matches aren't resolved."""
    def add(f: Callable[[RankInputs, DataFrame, DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*data(spark, sf_dir, resolved))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


def scores(resolved: DataFrame) -> DataFrame:
    return graph.entity_metrics(resolved).select("id", (F.col("weight") / (1 + F.col("share"))).alias("score"))


def members(resolved: DataFrame) -> DataFrame:
    return resolved.select("event_id", F.explode(F.concat("winners", "losers")).alias("id")).distinct()


@query("weighted_matches", _sql("SELECT match_id, event_id, winner_id, loser_id, ts, round(weight, 6) AS weight FROM wm"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(w.select("match_id", "event_id", "winner_id", "loser_id", "ts", "weight"), "weight")


@query("roster_sizes", _sql("SELECT event_id, group_id, count(*) AS size FROM pa GROUP BY ALL"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.rosters(i.participants).select("event_id", "group_id", "size")


@query("appearance_groups", _sql("SELECT event_id, match_id, group_id, count(*) AS size, min(entity_id) AS first, max(entity_id) AS last FROM ap GROUP BY ALL"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.appearance_groups(i.appearances, i.participants).select("event_id", "match_id", "group_id", "size", F.array_min("members").alias("first"), F.array_max("members").alias("last"))


@query("resolved_matches", _sql("SELECT match_id, event_id, winner_count, loser_count, round(share, 6) AS share, array_to_string(winners, ' ') AS winners, array_to_string(losers, ' ') AS losers FROM rs"))
def _(i, w, r):  # noqa: ANN001, ANN202
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return rounded(r, "share").select("match_id", "event_id", "winner_count", "loser_count", "share", text("winners"), text("losers"))


@query("resolved_by_rosters", _sql("SELECT count(*) AS matches, sum(a.n * b.n)::BIGINT AS pairs FROM wm JOIN (SELECT event_id, group_id, count(*) AS n FROM pa GROUP BY ALL) a ON a.event_id = wm.event_id AND a.group_id = winner_id JOIN (SELECT event_id, group_id, count(*) AS n FROM pa GROUP BY ALL) b ON b.event_id = wm.event_id AND b.group_id = loser_id"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.resolve(w, i.participants).agg(F.count("*").alias("matches"), F.sum(F.col("winner_count") * F.col("loser_count")).alias("pairs"))


@query("entity_metrics", _sql("SELECT id, round(share, 6) AS share, round(weight, 6) AS weight, ts FROM em"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(graph.entity_metrics(r), "share", "weight")


@query("exposure_pair_edges", _sql("SELECT winner_id, loser_id, round(share, 6) AS share FROM pe"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(graph.pair_edges(r), "share")


@query("row_edges", _sql("SELECT loser_id, winner_id, round(weight_sum, 6) AS weight_sum FROM re"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(graph.row_edges(r), "weight_sum")


@query("team_edges", _sql("SELECT loser_id, winner_id, round(sum(weight), 6) AS weight_sum FROM wm GROUP BY ALL"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(graph.group_edges(w), "weight_sum")


@query("index_mapping", _sql("SELECT node AS id, row_number() OVER (ORDER BY node) - 1 AS idx FROM nd"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return graph.index_mapping(graph.merged_nodes(r))


@query("exposure_triplets", _sql("SELECT a.idx AS row, b.idx AS col, round(share, 6) AS value FROM pe JOIN ix a ON a.node = winner_id JOIN ix b ON b.node = loser_id", "ix AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM nd)"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(graph.triplets(graph.pair_edges(r), graph.appeared(r), "winner_id", "loser_id", "share"), "value")


for _name, _formula in {"none": "loss", "wins_proportional": "loss + least(0.02 * win, loss)", "constant": "loss + 1e-6", "adaptive": "loss + win * 0.1 / (1 + (loss + win) / 100)", "hybrid": "loss + 1e-6 + 0.01 * win"}.items():
    query(f"denominators_{_name}", _sql(f"SELECT node, round(loss, 6) AS loss, round(win, 6) AS win, round({_formula}, 6) AS denom FROM dn"))(lambda i, w, r, n=_name: rounded(graph.denominators(graph.row_edges(r), smoothing.smoothing_strategy(n)), "loss", "win", "denom").drop("lambda"))


@query("normalized_edges", _sql("SELECT loser_id, winner_id, round(weight_sum / (loss + least(0.02 * win, loss)), 6) AS normalized_weight FROM re JOIN dn ON node = loser_id"))
def _(i, w, r):  # noqa: ANN001, ANN202
    edges = graph.row_edges(r)
    return rounded(graph.normalize(edges, graph.denominators(edges, smoothing.wins_proportional())).select("loser_id", "winner_id", "normalized_weight"), "normalized_weight")


def nodes(r: DataFrame) -> DataFrame:
    return graph.appeared(r).select(F.col("id").alias("node"))


@query("teleport_uniform", _sql("SELECT node, round(1 / n, 9) AS t FROM nd, n"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(teleport.uniform(nodes(r)), "t", digits=9)


@query("teleport_volume_inverse", _sql("SELECT node, round(x / sum(x) OVER (), 9) AS t FROM (SELECT node, 1 / sqrt(coalesce(c, 1)) AS x FROM nd LEFT JOIN (SELECT loser_id AS node, count(*) AS c FROM re GROUP BY ALL) USING (node))"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(teleport.volume_inverse(nodes(r), graph.row_edges(r), "loser_id"), "t", digits=9)


@query("teleport_custom", _sql("SELECT node, round(x / sum(x) OVER (), 9) AS t FROM (SELECT node, CASE WHEN node % 2 = 0 THEN 3.0::DOUBLE ELSE 1.0 END AS x FROM nd)"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(teleport.custom(nodes(r), nodes(r).where("node % 2 = 0").withColumn("w", F.lit(3.0))), "t", digits=9)


@query("teleport_share", _sql("SELECT node, round(t, 9) AS t FROM rho"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(teleport.from_share(nodes(r), graph.entity_metrics(r)), "t", digits=9)


def _rank_sql(src: str, dst: str, edges: str, weight: str, name: str = "k", steps: int = STEPS) -> str:
    """Power steps as nested tables."""
    out = [f"{name}f AS (SELECT {src} AS src, {dst} AS dst, {weight} / sum({weight}) OVER (PARTITION BY {src}) AS p FROM {edges})", f"{name}0 AS (SELECT node, t AS x FROM rho)"]
    for s in range(steps):
        out.append(f"{name}{s}u AS (SELECT rho.node, 0.85 * coalesce(f, 0) + 0.15 * t + 0.85 * t * (SELECT coalesce(sum(x), 0) FROM {name}{s} WHERE node NOT IN (SELECT src FROM {name}f)) AS y FROM rho LEFT JOIN (SELECT dst AS node, sum(p * x) AS f FROM {name}f JOIN {name}{s} ON node = src GROUP BY dst) USING (node))")
        out.append(f"{name}{s + 1} AS MATERIALIZED (SELECT node, y / sum(y) OVER () AS x FROM {name}{s}u)")
    return ", ".join(out)


def _fixed(r: DataFrame) -> DataFrame:
    """node, win_pr, loss_pr, teleport after STEPS steps."""
    rho = cut(teleport.from_share(nodes(r), graph.entity_metrics(r)))
    return engines.both_pageranks(cut(graph.pair_edges(r)), rho, PageRankConfig(tol=0.0, max_iter=STEPS))


WIN, LOSS = _rank_sql("loser_id", "winner_id", "pe", "share", "w"), _rank_sql("winner_id", "loser_id", "pe", "share", "v")
PR = f"pr AS (SELECT rho.node, w{STEPS}.x AS win_pr, v{STEPS}.x AS loss_pr, t FROM rho JOIN w{STEPS} USING (node) JOIN v{STEPS} USING (node)), la AS (SELECT 0.025 * median(win_pr) / median(t) AS l FROM pr)"


@query("win_pagerank_k", _sql(f"SELECT node, round(x, 9) AS rank FROM w{STEPS}", WIN))
def _(i, w, r):  # noqa: ANN001, ANN202
    return _fixed(r).select("node", (F.round("win_pr", 9) + 0.0).alias("rank"))


@query("loss_pagerank_k", _sql(f"SELECT node, round(x, 9) AS rank FROM v{STEPS}", LOSS))
def _(i, w, r):  # noqa: ANN001, ANN202
    return _fixed(r).select("node", (F.round("loss_pr", 9) + 0.0).alias("rank"))


@query("row_pagerank_k", _sql(f"SELECT node, round(x, 9) AS rank FROM q{STEPS}", _rank_sql("loser_id", "winner_id", "re", "weight_sum", "q")))
def _(i, w, r):  # noqa: ANN001, ANN202
    flows = cut(graph.row_edges(r)).select(F.lit("row").alias("graph"), F.col("loser_id").alias("src"), F.col("winner_id").alias("dst"), F.col("weight_sum").alias("w"))
    t = cut(teleport.from_share(nodes(r), graph.entity_metrics(r))).withColumn("graph", F.lit("row"))
    return pagerank(flows, t, 0.85, 0.0, STEPS).select("node", (F.round("rank", 9) + 0.0).alias("rank"))


@query("log_odds_rank_k", _sql("SELECT node AS entity_id, round(ln((win_pr + l * t) / (loss_pr + l * t)), 6) AS score FROM pr, la", f"{WIN}, {LOSS}, {PR}"))
def _(i, w, r):  # noqa: ANN001, ANN202
    pr = cut(_fixed(r))
    return rounded(pr.select(F.col("node").alias("entity_id"), scoring.log_odds(scoring.resolve_lambda(pr)).alias("score")), "score")


@query("quality_mass_k", _sql("SELECT node AS entity_id, round((win_pr + l * t) / (win_pr + loss_pr + 2 * l * t), 6) AS quality_mass FROM pr, la", f"{WIN}, {LOSS}, {PR}"))
def _(i, w, r):  # noqa: ANN001, ANN202
    pr = cut(_fixed(r))
    return rounded(pr.select(F.col("node").alias("entity_id"), scoring.quality_mass(scoring.resolve_lambda(pr)).alias("quality_mass")), "quality_mass")


@query("top_n", _sql("SELECT id AS entity_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, id LIMIT 25"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(scoring.top_n(scores(r).withColumnRenamed("id", "entity_id"), 25), "score")


CC = "ce AS (SELECT DISTINCT w AS a, l AS b FROM rs, unnest(winners) t(w), unnest(losers) u(l)), cb AS (SELECT a, b FROM ce UNION SELECT b, a FROM ce), cc(n, c) USING KEY (n) AS (SELECT a, least(a, min(b)) FROM cb GROUP BY a UNION SELECT k.n, min(o.c) FROM recurring.cc k JOIN cb ON cb.a = k.n JOIN cc o ON o.n = cb.b WHERE o.c < k.c GROUP BY k.n)"


@query("connected_components", _sql("SELECT n AS id, c AS component FROM cc", CC))
def _(i, w, r):  # noqa: ANN001, ANN202
    return connectivity.components(graph.pair_edges(r))


@query("component_summary", _sql("SELECT c AS component, count(*) AS nodes, round(sum(s), 6) AS share, round(sum(wt), 6) AS weight FROM cc JOIN (SELECT id AS n, sum(share) AS s, sum(weight) AS wt FROM mem GROUP BY id) USING (n) GROUP BY c", CC))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(connectivity.summary(connectivity.components(graph.pair_edges(r)), graph.entity_metrics(r)), "share", "weight")


@query("participants_by_event", _sql("SELECT event_id, count(*) AS n, min(id) AS first, max(id) AS last FROM mb GROUP BY ALL"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.participants_by_event(r).select("event_id", F.size("members").cast("long").alias("n"), F.array_min("members").alias("first"), F.array_max("members").alias("last"))


for _name, _formula in {"arithmetic": "avg(score)", "geometric": "exp(avg(ln(score + 1e-10)))", "top_20_sum": "avg(score) FILTER (place <= 20)", "top_20_geom": "exp(avg(ln(score + 1e-10)) FILTER (place <= 20))"}.items():
    query(f"influence_{_name}", _sql(f"SELECT event_id, round({_formula}, 6) AS strength FROM pl GROUP BY event_id"))(lambda i, w, r, n=_name: rounded(influence.tournament_influence(members(r), scores(r), n), "strength"))
for _name, _formula in {"sum": "sum(score)", "median": "median(score)", "top_10_sum": "sum(score) FILTER (place <= 10)", "top_20_sum": "sum(score) FILTER (place <= 20)", "top_20_mean": "avg(score) FILTER (place <= 20)", "sqrt_top_20_sum": "sqrt(sum(score) FILTER (place <= 20))"}.items():
    query(f"influence_compat_{_name}", _sql("SELECT event_id, round(s / avg(s) OVER (), 6) AS strength FROM i", f"i AS (SELECT event_id, {_formula} AS s FROM pl GROUP BY event_id)"))(lambda i, w, r, n=_name: rounded(influence.compat_influence(members(r), scores(r), n, 0.0), "strength"))
query("influence_compat_log_top_20_sum", _sql("SELECT event_id, round(l / avg(l) OVER (), 6) AS strength FROM (SELECT event_id, ln(1 + s / avg(s) OVER ()) AS l FROM i)", "i AS (SELECT event_id, sum(score) FILTER (place <= 20) AS s FROM pl GROUP BY event_id)"))(lambda i, w, r: rounded(influence.compat_influence(members(r), scores(r), "log_top_20_sum", 0.0), "strength"))
for _name, _formula in {"minmax": "0.5 + 1.5 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())", "zscore": "1 + greatest(-2, least(2, (s - avg(s) OVER ()) / stddev_pop(s) OVER ())) / 2", "log": "ln(1 + s)"}.items():
    query(f"normalize_{_name}", _sql(f"SELECT event_id, round({_formula}, 6) AS strength FROM i", "i AS (SELECT event_id, avg(score) AS s FROM pl GROUP BY event_id)"))(lambda i, w, r, n=_name: rounded(influence.normalize_influence(influence.tournament_influence(members(r), scores(r)), n), "strength"))


@query("multi_round_influence", _sql("SELECT event_id, round((avg(score) + 3 * avg(score) FILTER (place <= 20)) / 4, 6) AS strength FROM pl GROUP BY event_id"))
def _(i, w, r):  # noqa: ANN001, ANN202
    one, two = (influence.tournament_influence(members(r), scores(r), m).withColumn("round", F.lit(n)) for n, m in enumerate(("arithmetic", "top_20_sum")))
    weights = r.sparkSession.createDataFrame([(0, 1.0), (1, 3.0)], "round int, weight double")
    return rounded(influence.multi_round(one.unionByName(two), weights), "strength")


@query("retrospective_strength", _sql("SELECT winner_id AS id, round(sum(score * weight_sum * exp(-0.1 * weight_sum)), 6) AS strength FROM re JOIN sc ON id = loser_id GROUP BY winner_id"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(influence.retrospective_strength(graph.row_edges(r), scores(r).select(F.col("id").alias("node"), F.col("score").alias("rank"))), "strength")


@query("inactivity_decay", _sql(f"SELECT id, round((weight - 1) * exp(-0.01 * greatest(0, ({NOW} - ts) / 86400.0 - 30)), 6) AS score FROM em"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(graph.entity_metrics(r).select("id", times.inactivity_decay(F.col("weight") - 1, scoring.last_activity(F.col("ts"), NOW), NOW, 30, 0.01).alias("score")), "score")


@query("recency_filter", _sql(f"SELECT match_id, ts FROM wm WHERE ts >= {NOW} - 400 * 86400.0"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return times.filter_by_recency(w, "ts", NOW, 400).select("match_id", "ts")


QUERIES["time_features"] = lambda spark, sf_dir: times.add_time_features(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), "ts", 1706745600.0).select("event_id", (F.round("days_ago", 6) + 0.0).alias("days_ago"), "week_of_year", "day_of_week", "is_weekend")
ORACLES["time_features"] = "SELECT event_id, round((1706745600.0 - epoch(ts)) / 86400.0, 6) AS days_ago, weekofyear(ts)::INTEGER AS week_of_year, isodow(ts)::INTEGER AS day_of_week, isodow(ts) >= 5 AS is_weekend FROM events"
QUERIES["time_windows"] = lambda spark, sf_dir: times.time_windows(spark, 0.0, 40 * 86400.0, 7, 3)
ORACLES["time_windows"] = "SELECT i * 3 * 86400.0::DOUBLE AS window_start, least(i * 3 * 86400.0::DOUBLE + 7 * 86400.0, 40 * 86400.0)::DOUBLE AS window_end FROM range(0, 14) t(i)"


@query("multi_group_entities", _sql("SELECT event_id, entity_id, count(DISTINCT group_id) AS n_groups FROM pa GROUP BY ALL HAVING count(DISTINCT group_id) > 1"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.several_groups(i.participants)


@query("match_side_coverage", _sql("SELECT round(count(*) FILTER (EXISTS (SELECT 1 FROM ap WHERE ap.match_id = s.match_id AND ap.group_id = s.g AND ap.match_id % 3 = 0)) / count(*), 6) AS coverage FROM (SELECT match_id, winner_id AS g FROM m UNION SELECT match_id, loser_id FROM m) s"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return i.matches.sparkSession.createDataFrame([(round(fit.side_coverage(i.matches, i.appearances.where("match_id % 3 = 0")), 6),)], "coverage double")


@query("anti_membership", _sql("SELECT ap.* FROM ap WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.event_id = ap.event_id AND pa.group_id = ap.group_id AND pa.entity_id = ap.entity_id AND pa.entity_id % 7 <> 0)"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.membership(i.appearances, i.participants.where("entity_id % 7 <> 0")).invalid.select("event_id", "match_id", "group_id", "entity_id")


@query("semi_membership", _sql("SELECT ap.* FROM ap WHERE EXISTS (SELECT 1 FROM pa WHERE pa.event_id = ap.event_id AND pa.group_id = ap.group_id AND pa.entity_id = ap.entity_id AND pa.entity_id % 7 <> 0)"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.membership(i.appearances, i.participants.where("entity_id % 7 <> 0")).valid.select("event_id", "match_id", "group_id", "entity_id")


@query("filter_resolved_matches", _sql("SELECT match_id FROM rs WHERE list_bool_and(list_transform(winners || losers, lambda x: x % 11 <> 0))"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.keep_entities(r, graph.appeared(r).where("id % 11 <> 0")).select("match_id")


@query("rank_entities_default", resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    config = ExposureLogOddsConfig(decay=DecayConfig(HALF_LIFE), tick_tock=TickTockConfig(decay=DecayConfig(HALF_LIFE)))
    return engines.ExposureLogOddsEngine(config, NOW).rank_entities(i.matches, i.participants, i.appearances)


#: Steps after which nothing moves by more than rounding.
MANY = 80
CONVERGED = f"{_rank_sql('loser_id', 'winner_id', 'pe', 'share', 'w', MANY)}, {_rank_sql('winner_id', 'loser_id', 'pe', 'share', 'v', MANY)}, {PR.replace(f'w{STEPS}', f'w{MANY}').replace(f'v{STEPS}', f'v{MANY}')}, ag AS (SELECT node, win_pr, loss_pr, weight, ln((win_pr + l * t) / (loss_pr + l * t)) * exp(-0.01 * greatest(0, ({NOW} - ts) / 86400.0 - 30)) AS score FROM pr JOIN em ON id = node, la)"


@query("rank_entities_converged", _sql("SELECT row_number() OVER (ORDER BY score DESC, node) AS player_rank, node AS entity_id, round(score, 6) AS score, round(win_pr, 9) AS win_pr, round(loss_pr, 9) AS loss_pr, round(weight, 6) AS exposure FROM ag", CONVERGED), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    config = ExposureLogOddsConfig(decay=DecayConfig(HALF_LIFE), use_tick_tock_active=False, pagerank=PageRankConfig(tol=1e-14, max_iter=MANY))
    out = engines.ExposureLogOddsEngine(config, NOW).rank_entities(i.matches, i.participants, i.appearances, component_policy="allow")
    return rounded(rounded(out, "score", "exposure"), "win_pr", "loss_pr", digits=9)


@query("rank_entities_plain", resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    config = ExposureLogOddsConfig(decay=DecayConfig(HALF_LIFE), use_tick_tock_active=False)
    return engines.ExposureLogOddsEngine(config, NOW).rank_entities(i.matches, i.participants, i.appearances, component_policy="allow")


@query("tick_tock", resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return engines.TickTockEngine(TickTockConfig(decay=DecayConfig(HALF_LIFE)), NOW).rank_entities(i.matches, i.participants, i.appearances)


@query("ttl_logodds", resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return engines.TTLEngine(TickTockConfig(max_ticks=2), engines.LogOddsBackend(decay=DecayConfig(HALF_LIFE)), NOW).rank_entities(i.matches, i.participants)


@query("ttl_rowpr", resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return engines.TTLEngine(TickTockConfig(max_ticks=2), engines.RowPageRankBackend(decay=DecayConfig(HALF_LIFE)), NOW).rank_entities(i.matches, i.participants)


def _loo(i: RankInputs, variant: str) -> DataFrame:
    engine = engines.ExposureLogOddsEngine(ExposureLogOddsConfig(decay=DecayConfig(HALF_LIFE), engine=EngineConfig(score_decay_rate=0.0), use_tick_tock_active=False), NOW)
    engine.rank_entities(i.matches, i.participants, i.appearances, component_policy="allow")
    busiest = graph.entity_metrics(engine.state["resolved"]).orderBy(F.desc("weight"), "id").first()["id"]
    return engine.analyze_entity_matches(busiest, variant=variant)


query("loo_exact", resolved=False)(lambda i, w, r: _loo(i, "exact_combined"))
query("loo_neumann", resolved=False)(lambda i, w, r: _loo(i, "perturb_4"))


FLUX = f"""{WIN}, {LOSS}, {PR},
side AS (SELECT event_id, match_id, share, unnest(winners) AS id, true AS won FROM rs UNION ALL SELECT event_id, match_id, share, unnest(losers), false FROM rs),
bu AS (SELECT id FROM em ORDER BY weight DESC, id LIMIT 1),
ko AS (SELECT pr.node, win_pr, loss_pr, lost, won FROM pr LEFT JOIN (SELECT loser_id AS node, sum(share) AS lost FROM pe GROUP BY ALL) USING (node) LEFT JOIN (SELECT winner_id AS node, sum(share) AS won FROM pe GROUP BY ALL) USING (node)),
fx AS (SELECT me.event_id, me.match_id, me.won AS is_win, sum(CASE WHEN me.won THEN coalesce(o.share * ko.win_pr / ko.lost, 0) + coalesce(o.share * k.loss_pr / k.won, 0) ELSE coalesce(o.share * k.win_pr / k.lost, 0) + coalesce(o.share * ko.loss_pr / ko.won, 0) END) AS flux
FROM side me JOIN bu ON me.id = bu.id JOIN side o ON o.event_id = me.event_id AND o.match_id = me.match_id AND o.won <> me.won JOIN ko ON ko.node = o.id JOIN ko k ON k.node = bu.id GROUP BY ALL)"""


@query("loo_flux_topk", _sql("SELECT event_id, match_id, is_win, round(flux, 9) AS flux FROM fx ORDER BY fx.flux DESC, match_id LIMIT 20", FLUX))
def _(i, w, r):  # noqa: ANN001, ANN202
    state = {"resolved": r, "edges": cut(graph.pair_edges(r)), "pr": cut(_fixed(r))}
    busiest = graph.entity_metrics(r).orderBy(F.desc("weight"), "id").first()["id"]
    return rounded(loo.match_flux(state, busiest).orderBy(F.desc("flux"), "match_id").limit(20), "flux", digits=9)


@query("fit_report", resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return fit.assess_dataset_fit(i.matches, i.participants, i.appearances).to_dataframe(i.matches.sparkSession)


#: Matches with missing times, byes and missing sides, and an influence of events, by rules that SQL has too.
ODD = f"odd AS (SELECT event_id, match_id, CASE WHEN match_id % 13 <> 0 THEN winner_id END AS winner_id, loser_id, CASE WHEN match_id % 7 <> 0 THEN completed_at END AS completed_at, CASE WHEN match_id % 5 = 0 THEN NULL ELSE match_id % 11 = 0 END AS walkover FROM m), kept AS (SELECT * FROM odd WHERE winner_id IS NOT NULL AND NOT coalesce(walkover, false)), st AS (SELECT DISTINCT event_id, 1.0 + event_id % 3 AS strength FROM m WHERE event_id % 4 <> 0)"


def odd_matches(i: RankInputs) -> tuple[DataFrame, DataFrame]:
    rule = lambda test, c: F.when(F.expr(test), F.col(c)).alias(c)
    bye = F.when(F.expr("match_id % 5 <> 0"), F.expr("match_id % 11 = 0")).alias("walkover")
    odd = i.matches.select("event_id", "match_id", rule("match_id % 13 <> 0", "winner_id"), "loser_id", rule("match_id % 7 <> 0", "completed_at"), bye)
    strength = i.matches.where("event_id % 4 <> 0").select("event_id", F.expr("1.0D + event_id % 3").alias("strength")).distinct()
    return odd, strength


@query("competitive_matches", _sql("SELECT event_id, match_id, winner_id, loser_id FROM kept", ODD), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.competitive(odd_matches(i)[0]).select("event_id", "match_id", "winner_id", "loser_id")


for _name, _fill in {"now": f"{NOW}", "beginning": "1.0"}.items():
    query(f"weighted_missing_times_{_name}", _sql(f"SELECT match_id, coalesce(completed_at, {_fill}) AS ts, round(exp(-{RATE!r} * ({NOW} - coalesce(completed_at, {_fill})) / 86400.0) * sqrt(coalesce(strength, 1)), 6) AS weight FROM kept LEFT JOIN st USING (event_id)", ODD), resolved=False)(lambda i, w, r, n=_name: rounded(resolve.weighted_matches(odd_matches(i)[0], NOW, RATE, 0.5, odd_matches(i)[1], legacy_fill=n == "beginning").select("match_id", "ts", "weight"), "weight"))


@query("team_edges_public", _sql(f"SELECT loser_id, winner_id, round(sum(exp(-{RATE!r} * ({NOW} - coalesce(completed_at, 1.0)) / 86400.0) * coalesce(strength, 1)), 6) AS weight_sum FROM kept LEFT JOIN st USING (event_id) GROUP BY ALL", ODD), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    odd, strength = odd_matches(i)
    return rounded(inputs.team_edges(odd, strength, NOW, RATE, 1.0), "weight_sum")


@query("player_edges_public", _sql(f"SELECT l.entity_id AS loser_id, w.entity_id AS winner_id, round(sum(exp(-{RATE!r} * ({NOW} - coalesce(completed_at, {NOW})) / 86400.0)), 6) AS weight_sum FROM odd k JOIN pa w ON w.event_id = k.event_id AND w.group_id = k.winner_id JOIN pa l ON l.event_id = k.event_id AND l.group_id = k.loser_id WHERE NOT coalesce(walkover, false) GROUP BY ALL", ODD), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(inputs.player_edges(odd_matches(i)[0], i.participants, None, NOW, RATE), "weight_sum")


@query("converted_matches", _sql("SELECT match_id, winner_count, loser_count, round(share, 6) AS share FROM rs"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(inputs.convert_matches(i.matches, i.participants, None, NOW, RATE, appearances=i.appearances).select("match_id", "winner_count", "loser_count", "share"), "share")


@query("node_mapping_lists", _sql("SELECT node AS id, row_number() OVER (ORDER BY node) - 1 AS idx FROM nd"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return inputs.node_mapping(r)


@query("node_mapping_columns", _sql("SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT winner_id AS id FROM m UNION SELECT loser_id FROM m)"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return inputs.node_mapping(i.matches, "winner_id", "loser_id")


@query("factorized_ids", _sql("SELECT winner_id AS id, row_number() OVER (ORDER BY min(match_id)) - 1 AS idx FROM m GROUP BY winner_id"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return inputs.factorized(i.matches, "winner_id", "match_id")


@query("older_names", _sql("SELECT event_id AS tournament_id, match_id, winner_id AS winner_team_id, loser_id AS loser_team_id, completed_at AS last_game_finished_at FROM m"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return prepared(*i, older=True).matches


@query("roster_members", _sql("SELECT event_id, group_id, array_to_string(list(entity_id ORDER BY entity_id), ' ') AS members FROM pa GROUP BY ALL"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.rosters(i.participants).select("event_id", "group_id", F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("members"))


@query("appearance_members", _sql("SELECT event_id, match_id, group_id, array_to_string(list(entity_id ORDER BY entity_id), ' ') AS members FROM ap GROUP BY ALL"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.appearance_groups(i.appearances, i.participants).select("event_id", "match_id", "group_id", F.array_join(F.transform(F.array_sort("members"), lambda x: x.cast("string")), " ").alias("members"))


@query("event_members", _sql("SELECT event_id, array_to_string(list(id ORDER BY id), ' ') AS members FROM mb GROUP BY ALL"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return resolve.participants_by_event(r).select("event_id", F.array_join(F.transform(F.array_sort("members"), lambda x: x.cast("string")), " ").alias("members"))


@query("half_life", _sql(f"SELECT match_id, round(pow(0.5, ({NOW} - ts) / 86400.0 / 90), 9) AS factor FROM wm"), resolved=False)
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(w.select("match_id", times.half_life_decay((F.lit(NOW) - F.col("ts")) / 86400.0, 90).alias("factor")), "factor", digits=9)


@query("ranked_scores", _sql("SELECT row_number() OVER (ORDER BY score DESC, id) AS player_rank, id AS entity_id, round(score, 6) AS score FROM sc JOIN em USING (id) WHERE em.weight >= 0.01"))
def _(i, w, r):  # noqa: ANN001, ANN202
    each = graph.entity_metrics(r).select(F.col("id").alias("entity_id"), (F.col("weight") / (1 + F.col("share"))).alias("score"), F.col("weight").alias("exposure"))
    return rounded(scoring.ranked(each, 0.01), "score").drop("exposure")


@query("result_table", _sql("SELECT id AS node, round(score, 6) AS value FROM sc"))
def _(i, w, r):  # noqa: ANN001, ANN202
    return rounded(RankResult(scores(r).withColumnRenamed("id", "entity_id")).to_dataframe("node", "value"), "value")
