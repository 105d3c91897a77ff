"""Does a dataset suit the ranking?  A few small aggregates and a report."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.operators import connectivity, graph, resolve
from skirmish.session import cut
from skirmish.sources.schema import prepared

PASS, WARN, FAIL = "pass", "warn", "fail"


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    detail: str
    value: float | None = None


@dataclass(frozen=True)
class FitReport:
    overall: str
    checks: tuple[Check, ...]
    metrics: dict

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.name, c.status, c.value, c.detail) for c in self.checks], "check string, status string, value double, detail string")


def sides(matches: DataFrame) -> DataFrame:
    """The different (event, match, group) of matches."""
    return matches.select("event_id", "match_id", F.explode(F.array("winner_id", "loser_id")).alias("group_id")).distinct()


def side_coverage(matches: DataFrame, appearances: DataFrame) -> float:
    """Share of the sides of matches that have appearances."""
    wanted = sides(matches)
    keys = ["event_id", "match_id", "group_id"]
    seen = wanted.join(appearances.select(*keys).distinct(), keys)
    total = wanted.count()
    return seen.count() / total if total else 0.0


def assess_dataset_fit(matches: DataFrame, participants: DataFrame, appearances: DataFrame | None = None) -> FitReport:
    matches, participants, appearances = prepared(matches, participants, appearances)
    matches, participants = cut(matches), cut(participants)  # read many times below
    played = resolve.competitive(matches)
    sizes = resolve.rosters(participants).agg(F.count("*").alias("n"), F.max("size").alias("most"), F.avg("size").alias("mean")).first()
    twice = resolve.several_groups(participants)
    n, several = played.count(), twice.count()
    checks = [Check("competitive_matches", PASS if n else FAIL, f"{n} matches with two sides", float(n))]
    known = cut(participants.select("event_id", "group_id").distinct())
    missing = sides(played).join(known, ["event_id", "group_id"], "left_anti")
    resolvable = played
    for side in ("winner_id", "loser_id"):
        resolvable = resolvable.join(known.withColumnRenamed("group_id", side), ["event_id", side], "left_semi")
    resolvable = cut(resolvable)
    lost, fine = missing.count(), resolvable.count()
    checks.append(Check("team_rosters", FAIL if lost else PASS, f"{lost} sides of matches have no roster", float(lost)))
    metrics = {"match_count": matches.count(), "competitive_match_count": n, "roster_count": sizes["n"], "max_roster_size": sizes["most"], "mean_roster_size": sizes["mean"], "multi_team_entities": several, "missing_roster_sides": lost, "resolvable_match_count": fine}
    used = appearances
    if appearances is None:
        checks.append(Check("multi_team_membership_without_appearances", FAIL if several else PASS, f"{several} entities are in several groups of an event", float(several)))
        checks.append(Check("roster_fallback_risk", WARN if (sizes["most"] or 0) > 2 else PASS, f"the largest roster has {sizes['most']} members, all of whom count as playing", float(sizes["most"] or 0)))
    else:
        inferred = "group_id" not in appearances.columns
        checks.append(Check("appearance_team_inference", FAIL if inferred and several else PASS, "groups are inferred from rosters" if inferred else "appearances name their groups", float(several)))
        if inferred:
            least = participants.groupBy("event_id", "entity_id").agg(F.min("group_id").alias("group_id"))
            used = appearances.join(least, ["event_id", "entity_id"], "left")
        used = cut(used)
        valid = cut(resolve.membership(used, participants).valid)
        bad = used.count() - valid.count()
        checks.append(Check("appearance_participant_membership", FAIL if bad else PASS, f"{bad} appearances aren't on a roster", float(bad)))
        used = valid
        covered = side_coverage(played, used)
        text = "most sides have appearances" if covered >= 0.8 else "many sides fall back on rosters" if covered >= 0.5 else "most sides fall back on rosters"
        checks.append(Check("appearance_match_coverage", PASS if covered >= 0.8 else WARN, text, covered))
        metrics |= {"invalid_appearances": bad, "appearance_coverage": covered}
    if n:
        resolved = resolve.resolve(resolve.weighted_matches(resolvable, 0.0, 0.0, 0), participants, used, keep=True)
        report = connectivity.analyze(connectivity.components(graph.pair_edges(resolved)), graph.entity_metrics(resolved))
        apart = report.disconnected_share
        status = FAIL if not report.component_count else PASS if report.component_count == 1 else WARN if apart <= 0.005 else FAIL
        checks.append(Check("entity_graph_connectivity", status, f"{report.component_count} components; {apart:.1%} of the share lies outside the largest", float(apart)))
        metrics |= {"component_count": report.component_count, "node_count": report.node_count, "disconnected_share": apart}
    states = {c.status for c in checks}
    return FitReport("poor_fit" if FAIL in states else "usable_with_caution" if WARN in states else "good_fit", tuple(checks), metrics)
