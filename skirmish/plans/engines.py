"""The three engines: exposure log-odds, tick-tock, and a loop over a rating backend."""
from __future__ import annotations

import time
import warnings

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.config import DecayConfig, ExposureLogOddsConfig, PageRankConfig, TickTockConfig
from skirmish.functions import teleport
from skirmish.functions import time as times
from skirmish.operators import connectivity, flows, graph, influence, resolve, scoring
from skirmish.operators.blocks import Index
from skirmish.operators.pagerank import ARRAY_EDGES, WHOLE_NODES, iterate, pagerank
from skirmish.plans import loo
from skirmish.session import cut
from skirmish.sources.schema import prepared

POLICIES = ("keep_largest", "allow", "error")


def both_pageranks(edges: DataFrame, nodes: DataFrame, config: PageRankConfig) -> DataFrame:
    """(node, win_pr, loss_pr, teleport) from pair edges and (node, t)."""
    moves = edges.select(F.lit("win").alias("graph"), F.col("loser_id").alias("src"), F.col("winner_id").alias("dst"), F.col("share").alias("w"))
    moves = moves.union(edges.select(F.lit("loss"), "winner_id", "loser_id", "share"))
    two = nodes.select(F.explode(F.array(F.lit("win"), F.lit("loss"))).alias("graph"), "node", "t")
    ranks = pagerank(moves, two, config.alpha, config.tol, config.max_iter)
    return ranks.groupBy("node").agg(F.max(F.when(F.col("graph") == "win", F.col("rank"))).alias("win_pr"), F.max(F.when(F.col("graph") == "loss", F.col("rank"))).alias("loss_pr")).join(nodes.select("node", F.col("t").alias("teleport")), "node")


def roster_flows(weighted: DataFrame, participants: DataFrame, share: bool = False) -> flows.RosterFlows | None:
    """The graph of all pairs of rosters that met, as a product, if there are many; None if arrays or pairs will do (or ids
    aren't integers)."""
    if not isinstance(participants.schema["entity_id"].dataType, T.IntegralType):
        return None
    resolved = resolve.resolve(weighted, participants, check=False)
    pairs, lost = resolved.agg(F.sum(F.col("winner_count") * F.col("loser_count")), F.count_if(F.expr("coalesce(winner_count, 0) = 0 OR coalesce(loser_count, 0) = 0"))).first()
    if lost:
        resolve.resolve(weighted, participants)  # raises, with samples
    if (pairs or 0) <= ARRAY_EDGES or participants.select("event_id", "group_id").distinct().count() > WHOLE_NODES:
        return None
    return flows.RosterFlows(weighted, participants, share)


def whole_ranks(flow: flows.PairFlows | flows.RosterFlows, index: Index, t: np.ndarray, factors: np.ndarray, config: PageRankConfig) -> np.ndarray:
    """Ranks by place of row edges (one graph), or of win and loss edges (two)."""
    graphs = len(index.spans)
    sums = flow.sums(factors) if graphs == 1 else flow.sums(factors, graphs)
    return iterate(index, t, sums.ravel(), lambda x: flow.flow(x.reshape(graphs, -1), factors).ravel(), config.alpha, config.tol, config.max_iter)


class TickTockEngine:
    """Row PageRank in turn with the influence of events."""

    def __init__(self, config: TickTockConfig | None = None, now_ts: float | None = None) -> None:
        self.config, self.clock = config or TickTockConfig(), times.Clock(now_ts)
        self.influence: DataFrame | None = None
        self.ticks = 0

    def rank_entities(self, matches: DataFrame, participants: DataFrame, appearances: DataFrame | None = None, tournament_influence: DataFrame | None = None) -> DataFrame:
        """(entity_id, score)"""
        matches, participants, appearances = prepared(matches, participants, appearances)
        c, now = self.config, self.clock.now
        matches, participants = cut(matches), cut(participants)  # read many times below
        # a match's weight is its age's times its event's strength, so pairs are summed per event once
        base = resolve.weighted_matches(matches, now, c.decay.decay_rate, beta=0, legacy_fill=True)
        flow = roster_flows(base, participants) if appearances is None else None
        if flow:
            members = cut(flow.rows.select("event_id", "id").distinct())
        else:
            resolved = resolve.resolve(base, participants, appearances, share=False)
            pairs = cut(graph.event_row_edges(resolved))
            members = cut(resolved.select("event_id", F.explode(F.concat("winners", "losers")).alias("id")).where("id IS NOT NULL").distinct())
        strength = tournament_influence or matches.select("event_id").distinct().withColumn("strength", F.lit(1.0))
        scores = None
        tol = min(c.convergence_tol, 1e-4)
        nodes = members.select(F.col("id").alias("node")).distinct()
        if not flow and isinstance(members.schema["id"].dataType, T.IntegralType) and pairs.count() > ARRAY_EDGES:
            nodes = cut(nodes)
            if nodes.count() <= WHOLE_NODES:
                flow = flows.PairFlows(pairs, np.sort(nodes.toArrow()["node"].to_numpy()))
        if flow:  # which pairs there are, and so the teleport, doesn't depend on the strengths
            nodes = cut(nodes.withColumn("graph", F.lit("row")))
            t = teleport.uniform(nodes) if c.teleport_mode == "uniform" else teleport.inverse_root(nodes, flow.edges())
            index, t = Index.of(t.select(F.lit("row").alias("graph"), F.col("node").alias("id"), "t"), "t")
            if isinstance(flow, flows.RosterFlows):
                flow.deal(index.ids["row"])
        for self.ticks in range(1, c.max_ticks + 1):
            if flow:
                ranks = whole_ranks(flow, index, t, flows.factors(flow.events, strength, float(c.engine.beta)), c.pagerank)
                scores = index.table(nodes, ranks).select(F.col("node").alias("id"), F.col("rank").alias("score"))
                prior = float(np.quantile(ranks, 0.05)) if len(ranks) else None
            else:
                factor = F.pow(F.coalesce("strength", F.lit(1.0)), F.lit(float(c.engine.beta)))
                edges = cut(pairs.join(F.broadcast(strength), "event_id", "left").groupBy("loser_id", "winner_id").agg(F.sum(F.col("base") * factor).alias("w")))
                moves = edges.select(F.lit("row").alias("graph"), F.col("loser_id").alias("src"), F.col("winner_id").alias("dst"), "w")
                t = teleport.uniform(nodes) if c.teleport_mode == "uniform" else teleport.volume_inverse(nodes, moves, "src")
                scores = cut(pagerank(moves, t.withColumn("graph", F.lit("row")), c.pagerank.alpha, c.pagerank.tol, c.pagerank.max_iter).select(F.col("node").alias("id"), F.col("rank").alias("score")))
                prior = scores.agg(F.percentile("score", 0.05)).first()[0]
            if prior is None:
                break
            new = cut(influence.mean_one(influence.compat_influence(members, scores, c.influence_method, prior)))
            moved = new.withColumnRenamed("strength", "new").join(strength, "event_id", "full").agg(F.avg(F.abs(F.coalesce("new", F.lit(1.0)) - F.coalesce("strength", F.lit(1.0))))).first()[0]
            strength = new
            if moved is None or moved < tol:
                break
        self.influence = strength
        return scores.select(F.col("id").alias("entity_id"), "score")


class ExposureLogOddsEngine:
    """Log-odds of two PageRanks with one exposure teleport."""

    def __init__(self, config: ExposureLogOddsConfig | None = None, now_ts: float | None = None) -> None:
        self.config, self.clock = config or ExposureLogOddsConfig(), times.Clock(now_ts)
        self.last_stage_timings: dict[str, float] = {}
        self.last_connectivity_report: connectivity.ConnectivityReport | None = None
        self.warning_message: str | None = None
        self.state: dict = {}

    def rank_entities(self, matches: DataFrame, participants: DataFrame, appearances: DataFrame | None = None, tournament_influence: DataFrame | None = None, component_policy: str = "keep_largest") -> DataFrame:
        """player_rank, entity_id, score, win_pr, loss_pr, exposure"""
        if component_policy not in POLICIES:
            raise ValueError(f"component_policy must be one of {', '.join(POLICIES)}")
        began = last = time.perf_counter()
        timings: dict[str, float] = {}

        def done(stage: str) -> None:
            nonlocal last
            timings[stage], last = time.perf_counter() - last, time.perf_counter()

        matches, participants, appearances = prepared(matches, participants, appearances)
        c, now = self.config, self.clock.now
        matches, participants = cut(matches), cut(participants)  # read many times below
        done("input_normalization")
        active = participants.select(F.col("entity_id").alias("id")).where("id IS NOT NULL").distinct()
        if c.use_tick_tock_active:
            tick = TickTockEngine(c.tick_tock, now)
            active = tick.rank_entities(matches, participants).select(F.col("entity_id").alias("id"))
            tournament_influence = tick.influence
        done("active_resolution")
        weighted = resolve.weighted_matches(matches, now, c.decay.decay_rate, c.engine.beta, tournament_influence)
        resolved = resolve.resolve(weighted, participants, appearances, keep=True)
        done("match_preparation")
        metrics, edges = cut(graph.entity_metrics(resolved)), cut(graph.pair_edges(resolved))
        labels = connectivity.components(edges)
        report = self.last_connectivity_report = connectivity.analyze(labels, metrics)
        self.warning_message = None
        if report.is_disconnected:
            if component_policy == "error":
                raise ValueError(connectivity.message(report, component_policy))
            self.warning_message = connectivity.message(report, component_policy)
            if component_policy == "keep_largest":
                kept = labels.where(F.col("component") == report.largest_component).select("id")
                resolved = cut(resolve.keep_entities(resolved, kept))
                metrics, edges = cut(graph.entity_metrics(resolved)), cut(graph.pair_edges(resolved))
                active = active.join(kept, "id", "left_semi")
        nodes = graph.merged_nodes(resolved, active).select(F.col("id").alias("node"))
        done("node_setup")
        rho = cut(teleport.from_share(nodes, metrics))
        done("graph_build")
        pr = cut(both_pageranks(edges, rho, c.pagerank))
        done("pagerank")
        lam = scoring.resolve_lambda(pr, c.lambda_mode, c.fixed_lambda, c.engine.lambda_smooth)
        full = pr.join(metrics.select(F.col("id").alias("node"), "weight", "ts"), "node", "left")
        raw = scoring.log_odds(lam, c.apply_log_transform)
        aged = times.inactivity_decay(F.col("raw"), scoring.last_activity(F.col("ts"), now), now, c.engine.score_decay_delay_days, c.engine.score_decay_rate)
        full = full.withColumn("raw", raw).withColumn("score", aged if c.engine.score_decay_rate > 0 else F.col("raw"))
        out = full.select(F.col("node").alias("entity_id"), "score", "win_pr", "loss_pr", F.coalesce("weight", F.lit(0.0)).alias("exposure"))
        done("score_postprocess")
        result = scoring.ranked(out, c.engine.min_exposure)
        self.state = {"resolved": resolved, "edges": edges, "pr": pr, "lambda": lam, "scores": out, "alpha": c.pagerank.alpha}
        done("result_assembly")
        self.last_stage_timings = timings | {"total": time.perf_counter() - began}
        return result

    def prepare_loo_analyzer(self, force_rebuild: bool = False) -> loo.Graphs:
        """The graphs of the last ranking, kept until the next one or until a rebuild is asked for."""
        if not self.state:
            raise ValueError("rank_entities must be called first")
        if force_rebuild or "graphs" not in self.state:
            self.state["graphs"] = loo.graphs(self.state)
        return self.state["graphs"]

    def analyze_match_impact(self, match_id: int, entity_id: int, variant: str = "exact_combined") -> dict:
        """What one match did to an entity's score; zeros if the entity wasn't in it."""
        self.prepare_loo_analyzer()
        found = loo.entity_matches(self.state, entity_id, None, variant, match_id).collect()
        if found:
            return found[0].asDict()
        score = self.state["scores"].where(F.col("entity_id") == entity_id).select("score").first()
        actual = score[0] if score else 0.0
        return {"match_id": match_id, "is_win": None, "old_score": actual, "new_score": actual} | dict.fromkeys(("score_delta", "abs_delta", "win_pr_delta", "loss_pr_delta"), 0.0)

    def analyze_entity_matches(self, entity_id: int, limit: int | None = None, variant: str = "exact_combined") -> DataFrame:
        """What each match of an entity did to its score, by leaving it out."""
        self.prepare_loo_analyzer()
        return loo.entity_matches(self.state, entity_id, limit, variant)


def rank_entities(matches: DataFrame, participants: DataFrame, appearances: DataFrame | None = None, tournament_influence: DataFrame | None = None, config: ExposureLogOddsConfig | None = None, now_ts: float | None = None, component_policy: str = "keep_largest") -> DataFrame:
    """The ranking by the default engine; warns if the comparison graph is disconnected."""
    engine = ExposureLogOddsEngine(config, now_ts)
    out = engine.rank_entities(matches, participants, appearances, tournament_influence, component_policy)
    if engine.warning_message:
        warnings.warn(engine.warning_message, stacklevel=2)
    return out


class RatingBackend(Protocol):
    def compute(self, matches: DataFrame, participants: DataFrame, influence: DataFrame | None, now: float) -> DataFrame:
        """id, score, quality_mass and more"""


class LogOddsBackend:
    def __init__(self, pagerank: PageRankConfig | None = None, decay: DecayConfig | None = None, beta: float = 1.0, fixed_lambda: float | None = None) -> None:
        self.pagerank, self.decay, self.beta, self.fixed_lambda = pagerank or PageRankConfig(), decay or DecayConfig(), beta, fixed_lambda

    def compute(self, matches: DataFrame, participants: DataFrame, influence: DataFrame | None, now: float) -> DataFrame:
        active = participants.select(F.col("entity_id").alias("id")).where("id IS NOT NULL").distinct()
        flow = roster_flows(resolve.weighted_matches(matches, now, self.decay.decay_rate, 0), participants, share=True)
        if flow:
            metrics = cut(flow.metrics(influence, self.beta))
            rho = cut(teleport.from_share(metrics.select("id").union(active).distinct().select(F.col("id").alias("node")), metrics, 1e-9))
            one, t = Index.of(rho.select(F.lit("win").alias("graph"), F.col("node").alias("id"), "t"), "t")
            ids = one.ids.get("win", np.zeros(0, int))
            flow.deal(ids)
            index = Index({"win": ids, "loss": ids})
            ranks = whole_ranks(flow, index, np.tile(t, 2), flows.factors(flow.events, influence, self.beta), self.pagerank)
            both = rho.select(F.lit("win").alias("graph"), "node")
            win, loss = (index.table(both.withColumn("graph", F.lit(g)), ranks, f"{g}_pr").drop("graph") for g in ("win", "loss"))
            pr = cut(rho.select("node", F.col("t").alias("teleport")).join(win, "node").join(loss, "node"))
        else:
            resolved = resolve.resolve(resolve.weighted_matches(matches, now, self.decay.decay_rate, self.beta, influence), participants, keep=True)
            metrics = graph.entity_metrics(resolved)
            rho = cut(teleport.from_share(graph.merged_nodes(resolved, active).select(F.col("id").alias("node")), metrics, 1e-9))
            pr = cut(both_pageranks(cut(graph.pair_edges(resolved)), rho, self.pagerank))
        lam = scoring.resolve_lambda(pr, "auto", self.fixed_lambda, 1e-4)
        out = pr.join(metrics.select(F.col("id").alias("node"), "weight"), "node", "left")
        return out.select(F.col("node").alias("id"), scoring.log_odds(lam).alias("score"), scoring.quality_mass(lam).alias("quality_mass"), "win_pr", "loss_pr", F.coalesce("weight", F.lit(0.0)).alias("exposure"), F.lit(float(lam)).alias("lambda_used"))


class RowPageRankBackend:
    def __init__(self, pagerank: PageRankConfig | None = None, decay: DecayConfig | None = None, beta: float = 1.0) -> None:
        self.pagerank, self.decay, self.beta = pagerank or PageRankConfig(), decay or DecayConfig(), beta

    def compute(self, matches: DataFrame, participants: DataFrame, influence: DataFrame | None, now: float) -> DataFrame:
        active = participants.select(F.col("entity_id").alias("id")).where("id IS NOT NULL").distinct()
        fill = influence is not None
        flow = roster_flows(resolve.weighted_matches(matches, now, self.decay.decay_rate, 0, legacy_fill=fill), participants)
        if flow:
            nodes = cut(active.select(F.lit("row").alias("graph"), F.col("id").alias("node")))
            index, t = Index.of(teleport.inverse_root(nodes, flow.edges()).select(F.lit("row").alias("graph"), F.col("node").alias("id"), "t"), "t")
            flow.deal(index.ids["row"])
            ranks = index.table(nodes, whole_ranks(flow, index, t, flows.factors(flow.events, influence, self.beta), self.pagerank))
        else:
            resolved = resolve.resolve(resolve.weighted_matches(matches, now, self.decay.decay_rate, self.beta, influence, legacy_fill=fill), participants, share=False)
            moves = cut(graph.row_edges(resolved)).select(F.lit("row").alias("graph"), F.col("loser_id").alias("src"), F.col("winner_id").alias("dst"), F.col("weight_sum").alias("w"))
            nodes = graph.merged_nodes(resolved, active).select(F.col("id").alias("node"))
            t = teleport.volume_inverse(nodes, moves, "src").withColumn("graph", F.lit("row"))
            ranks = pagerank(moves, t, self.pagerank.alpha, self.pagerank.tol, self.pagerank.max_iter)
        return ranks.select(F.col("node").alias("id"), F.col("rank").alias("score"), F.col("rank").alias("quality_mass"), F.col("rank").alias("pagerank"))


class TTLEngine:
    """A loop of a rating backend and the influence of events, damped by half from the second round."""

    def __init__(self, config: TickTockConfig | None = None, backend: RatingBackend | None = None, now_ts: float | None = None) -> None:
        self.config, self.backend, self.clock = config or TickTockConfig(), backend or LogOddsBackend(), times.Clock(now_ts)
        self.influence: DataFrame | None = None

    def rank_entities(self, matches: DataFrame, participants: DataFrame, appearances: DataFrame | None = None) -> DataFrame:
        """entity_id, score, active and what the backend adds.  Match counts are taken for one and last activity for now,
        so min_exposure above one leaves nothing and inactivity doesn't age."""
        matches, participants, appearances = prepared(matches, participants, appearances)
        c, now = self.config, self.clock.now
        matches, participants = cut(matches), cut(participants)  # read many times below
        members = participants.select("event_id", F.col("entity_id").alias("id")).where("id IS NOT NULL").distinct()
        strength = matches.select("event_id").distinct().withColumn("strength", F.lit(1.0))
        rated = None
        for tick in range(1, c.max_ticks + 1):
            rated = cut(self.backend.compute(matches, participants, strength, now))
            scores = rated.select("id", F.col("quality_mass").alias("score"))
            new = cut(influence.normalize_influence(influence.tournament_influence(members, scores, c.influence_method)))
            if tick > 1:
                both = strength.join(new.withColumnRenamed("strength", "new"), "event_id", "left").withColumn("new", F.coalesce("new", F.lit(1.0)))
                if (both.agg(F.avg(F.abs(F.col("new") - F.col("strength")))).first()[0] or 0.0) < c.convergence_tol:
                    break
                new = cut(both.select("event_id", (0.5 * F.col("strength") + 0.5 * F.col("new")).alias("strength")))
            strength = new
        self.influence = strength
        more = [x for x in ("win_pr", "loss_pr", "exposure", "quality_mass") if x in rated.columns]
        out = rated.select(F.col("id").alias("entity_id"), "score", F.lit(True).alias("active"), *more)
        return out.where(F.lit(1.0) >= c.engine.min_exposure) if c.engine.min_exposure is not None else out


