"""Leaving one match out: what it did to a score, with smoothing, node set and influence held."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.operators.pagerank import fixed_point, neumann
from skirmish.session import cut

#: Pair edges up to which the graph is handed to tasks as arrays.
MOST_EDGES = 20_000_000
#: Entries of a slice of a product.
SLICE = 1 << 18
#: Flux below which a match is taken to have no effect.
LEAST_FLUX = 1e-12
VARIANTS = {"exact_combined": 0, "exact_separate": 0, "exact_combined_numba": 0, "perturb_2": 2, "perturb_4": 4}
RESULT = "match_id long, is_win boolean, old_score double, new_score double, score_delta double, abs_delta double, win_pr_delta double, loss_pr_delta double"


def match_members(resolved: DataFrame) -> DataFrame:
    """(event_id, match_id, entity_id, is_win, share, winner_count, loser_count)"""
    side = lambda name, won: resolved.select("event_id", "match_id", F.explode(name).alias("entity_id"), F.lit(won).alias("is_win"), "share", "winner_count", "loser_count")
    return side("winners", True).union(side("losers", False)).where("entity_id IS NOT NULL")


def match_flux(state: dict, entity_id: int) -> DataFrame:
    """(event_id, match_id, is_win, flux): rank that flows over the entity's edges of a match, to first order."""
    members, pr = match_members(state["resolved"]), state["pr"]
    mine = members.where(F.col("entity_id") == entity_id).select("event_id", "match_id", "is_win").distinct()
    others = members.join(mine.withColumnRenamed("is_win", "won"), ["event_id", "match_id"]).where("is_win <> won")
    losses = state["edges"].groupBy(F.col("loser_id").alias("node")).agg(F.sum("share").alias("lost"))
    wins = state["edges"].groupBy(F.col("winner_id").alias("node")).agg(F.sum("share").alias("won_share"))
    known = pr.join(losses, "node", "left").join(wins, "node", "left")
    own = known.where(F.col("node") == entity_id).select(F.col("win_pr").alias("my_win"), F.col("loss_pr").alias("my_loss"), F.col("lost").alias("my_lost"), F.col("won_share").alias("my_won"))
    each = others.join(known.withColumnRenamed("node", "entity_id"), "entity_id").join(F.broadcast(own))
    part = lambda rank, total: F.when(F.coalesce(total, F.lit(0.0)) > 0, F.col("share") * rank / total).otherwise(0.0)
    won = part(F.col("win_pr"), F.col("lost")) + part(F.col("my_loss"), F.col("my_won"))
    lost = part(F.col("my_win"), F.col("my_lost")) + part(F.col("loss_pr"), F.col("won_share"))
    return each.groupBy("event_id", "match_id", F.col("won").alias("is_win")).agg(F.sum(F.when(F.col("won"), won).otherwise(lost)).alias("flux"))


class Shares:
    """Shares by row, for products with a vector; a slice of rows at a time, so that no array of all entries is made."""

    def __init__(self, row: np.ndarray, col: np.ndarray, share: np.ndarray, n: int) -> None:
        order = np.argsort(row, kind="stable")
        self.n, self.col, self.share = n, col[order].astype(np.int32), share[order]
        row = row[order]
        self.starts = np.flatnonzero(np.diff(row, prepend=-1))
        self.rows = row[self.starts]
        self.cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(row), SLICE)), len(self.starts)))

    def sums(self) -> np.ndarray:
        return self @ np.ones(self.n)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out, ends = np.zeros(self.n), np.append(self.starts, len(self.col))
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            some = slice(ends[a], ends[b])
            out[self.rows[a:b]] = np.add.reduceat(self.share[some] * x[self.col[some]], self.starts[a:b] - ends[a])
        return out


class Graphs:
    """Both graphs, and the effect of leaving a match out."""

    def __init__(self, ids: np.ndarray, rho: np.ndarray, ranks: dict[str, np.ndarray], winner: np.ndarray, loser: np.ndarray, share: np.ndarray, exposure: float, alpha: float, lam: float) -> None:
        self.ids, self.rho, self.ranks, self.alpha, self.lam, self.exposure = ids, rho, ranks, alpha, lam, exposure
        self.shares = {"win": Shares(winner, loser, share, len(ids)), "loss": Shares(loser, winner, share, len(ids))}
        self.sums = {"win": self.shares["loss"].sums(), "loss": self.shares["win"].sums()}

    def score(self, win: np.ndarray, loss: np.ndarray, rho: np.ndarray) -> np.ndarray:
        floor = 0.5 * (1 - self.alpha) * rho
        return np.log((np.maximum(win, floor) + self.lam * rho) / (np.maximum(loss, floor) + self.lam * rho))

    def without(self, winners: np.ndarray, losers: np.ndarray, share: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New win ranks, loss ranks and teleport.  Columns that the match empties get the new teleport, those that were
        empty before keep the old one."""
        n = len(self.ids)
        gone = np.zeros(n)
        np.subtract.at(gone, winners, share * len(losers) / self.exposure)
        np.subtract.at(gone, losers, share * len(winners) / self.exposure)
        rho = np.maximum(self.rho + gone, 0)
        rho /= rho.sum()
        out = []
        for g, shares in self.shares.items():
            a, b = (losers, winners) if g == "win" else (winners, losers)
            sums = self.sums[g]
            left = sums.copy()
            np.subtract.at(left, a, share * len(b))
            hanging, emptied = np.flatnonzero(sums <= 0), np.flatnonzero((sums > 0) & (left <= 1e-12 * sums))
            inverse = np.divide(1.0, left, out=np.zeros(n), where=left > 0)
            inverse[emptied] = 0

            def move(x: np.ndarray, shares=shares, a=a, b=b, inverse=inverse, hanging=hanging, emptied=emptied) -> np.ndarray:  # noqa: ANN001
                """All shares but the match's, over what is left of each sum."""
                each = x * inverse
                moved = shares @ each
                np.subtract.at(moved, b, share * each[a].sum())
                return moved + self.rho * x[hanging].sum() + rho * x[emptied].sum()

            # s = alpha (A s + old rho on hanging + new rho on emptied) + (1 - alpha) rho
            old = self.ranks[g]
            residual = self.alpha * move(old) + (1 - self.alpha) * rho - old
            out.append(old + (neumann(move, residual, self.alpha, steps) if steps else fixed_point(move, residual, self.alpha)))
        return out[0], out[1], rho


def graphs(state: dict) -> Graphs:
    """The arrays; bounded by MOST_EDGES."""
    if (many := state["edges"].count()) > MOST_EDGES:
        raise ValueError(f"leaving matches out takes graphs of up to {MOST_EDGES} edges; this one has {many}")
    pr = state["pr"].orderBy("node").toPandas()
    e = state["edges"].toPandas()
    ids = pr["node"].to_numpy()
    total = state["resolved"].agg(F.sum(F.col("share") * (F.col("winner_count") + F.col("loser_count")))).first()[0] or 0.0
    place = lambda c: np.searchsorted(ids, e[c].to_numpy())
    return Graphs(ids, pr["teleport"].to_numpy(), {"win": pr["win_pr"].to_numpy(), "loss": pr["loss_pr"].to_numpy()}, place("winner_id"), place("loser_id"), e["share"].to_numpy(), max(total, 1e-12), state["alpha"], state["lambda"])


def entity_matches(state: dict, entity_id: int, limit: int | None = None, variant: str = "exact_combined", match_id: int | None = None) -> DataFrame:
    """One row per match of the entity (the ``limit`` with most flux, or the one asked for), largest effect first.  A match
    over which next to nothing flows has an effect of zero."""
    if variant not in VARIANTS:
        raise ValueError(f"Unknown variant: {variant}")
    g, steps = state.get("graphs") or graphs(state), VARIANTS[variant]
    flux = match_flux(state, entity_id)
    if match_id is not None:
        flux = flux.where(F.col("match_id") == match_id)
    chosen = flux.orderBy(F.desc("flux"), "match_id", "event_id").limit(limit) if limit else flux
    rows = cut(state["resolved"].select("event_id", "match_id", "winners", "losers", "share").join(chosen, ["event_id", "match_id"]))
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(g)
    actual = state["scores"].where(F.col("entity_id") == entity_id).select("score").first()
    actual = actual[0] if actual else 0.0

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        g = shared.value
        me = int(np.searchsorted(g.ids, entity_id))
        before = g.score(g.ranks["win"], g.ranks["loss"], g.rho)[me]
        for batch in batches:
            out = []
            for m, won, w, lo, share, flux in zip(batch["match_id"], batch["is_win"], batch["winners"], batch["losers"], batch["share"], batch["flux"], strict=True):
                if flux < LEAST_FLUX:
                    out.append((m, won, actual, actual, 0.0, 0.0, 0.0, 0.0))
                    continue
                place = lambda x: np.searchsorted(g.ids, np.array([i for i in x if i is not None], dtype=g.ids.dtype))
                win, loss, rho = g.without(place(w), place(lo), share, steps)
                delta = g.score(win, loss, rho)[me] - before
                out.append((m, won, actual, actual + delta, delta, abs(delta), win[me] - g.ranks["win"][me], loss[me] - g.ranks["loss"][me]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    # each match is much work: as many tasks as can run at once, and no second time for the order's sample
    tasks = max(1, min(rows.count(), 2 * spark.sparkContext.defaultParallelism))
    return cut(rows.repartition(tasks).mapInPandas(run, RESULT)).orderBy(F.desc("abs_delta"), "match_id")


def compare_variants(baseline: DataFrame, candidate: DataFrame) -> dict:
    """How well one variant's effects agree with another's: overlap of the matches listed, rank correlation, mean error."""
    sizes = [df.count() for df in (baseline, candidate)]
    out = {"baseline_rows": sizes[0], "candidate_rows": sizes[1], "top_overlap": None, "shared_match_count": 0, "score_delta_spearman": None, "score_delta_mae": None}
    if not all(sizes):
        return out
    listed = [df.orderBy(F.desc("abs_delta"), "match_id").limit(min(sizes)).select("match_id") for df in (baseline, candidate)]
    both = candidate.select("match_id", "score_delta").join(baseline.select("match_id", F.col("score_delta").alias("of")), "match_id")
    for c in ("score_delta", "of"):  # equal values share the mean of their places, from counts of the values below
        counts = both.groupBy(c).agg(F.count("*").alias("n"))
        below = counts.alias("x").join(counts.withColumnsRenamed({c: "less", "n": "m"}), F.col("less") < F.col(c), "left").groupBy(c, "n").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
        both = both.join(below.select(c, (F.col("m") + (F.col("n") + 1) / 2).alias(f"place_{c}")), c)
    got = both.agg(F.count("*").alias("n"), F.corr("place_score_delta", "place_of").alias("r"), F.avg(F.abs(F.col("score_delta") - F.col("of"))).alias("e")).first()
    rho = got["r"] if got["n"] >= 2 and got["r"] is not None and got["r"] == got["r"] else None
    return out | {"top_overlap": listed[0].join(listed[1].distinct(), "match_id", "left_semi").distinct().count() / min(sizes), "shared_match_count": got["n"], "score_delta_spearman": rho, "score_delta_mae": got["e"]}
