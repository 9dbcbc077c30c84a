"""Payloads of analyses and plans for people and programs: evidence, compact summaries, effects by candidate."""

from __future__ import annotations

import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralift.operators.estimators import Estimate
from terralift.operators.inference import relative_interval
from terralift.operators.portfolio import Candidate
from terralift.operators.reports import clean, decision_status

Interval = tuple[float, float]


def point_clears_margin(value: float | None, kind: str, margin: float) -> bool | None:
    """Whether a point is on the good side of its framework's margin; None without a value."""
    if value is None or not math.isfinite(value):
        return None
    m = abs(margin)
    return {"non_inferiority": value > -m, "inferiority": value < m, "equivalence": abs(value) < m, "two_sided": value != 0}.get(kind, value > m)


def interval_status(interval: Interval | None, kind: str, margin: float) -> str:
    """clears, fails or crosses: where a whole interval stands to its framework's margin."""
    if interval is None:
        return "missing"
    low, high = interval
    m = abs(margin)
    if kind == "equivalence":
        return "clears" if -m < low and high < m else "fails" if low >= m or high <= -m else "crosses"
    if kind == "inferiority":
        return "clears" if high < m else "fails" if low >= m else "crosses"
    if kind == "two_sided":
        return "clears" if low > 0 or high < 0 else "crosses"
    edge = -m if kind == "non_inferiority" else m
    return "clears" if low > edge else "fails" if high <= edge else "crosses"


def lift_interval(result: Estimate, observed_total: float | None = None) -> Interval | None:
    """An estimate's interval as lifts: its own, the diagnosed one, or the effect's scaled like the point."""
    if result.relative_interval is not None:
        return result.relative_interval
    if (kept := result.diagnostics.get("relative_interval")) is not None:
        return tuple(kept)
    if observed_total is not None:
        return relative_interval(result.interval, observed_total)
    if result.interval is None or result.relative_lift is None or not result.estimate:
        return None
    low, high = sorted(e * result.relative_lift / result.estimate for e in result.interval)
    return low, high


def decision_evidence(results: list[Estimate], kind: str = "superiority", margin: float = 0.0, alpha: float = 0.05, scale: str = "absolute") -> dict[str, Any]:
    """How many of a metric's estimates support its claim by point, interval and p."""
    rows = []
    for r in results:
        if r.error:
            continue
        value, interval = (r.relative_lift, lift_interval(r)) if scale == "relative" else (r.estimate, r.interval)
        rows.append({"estimator": r.estimator, "point": point_clears_margin(value, kind, margin), "interval": interval_status(interval, kind, margin), "significant": r.p_value is not None and r.p_value <= alpha})
    count = lambda key, value: sum(row[key] == value for row in rows)
    return {"estimates": len(rows), "points": count("point", True), "intervals": count("interval", "clears"), "against": count("interval", "fails"), "significant": count("significant", True), "rows": rows}


def metric_groups(results: list[Estimate]) -> dict[str, list[int]]:
    """Places of the results of each metric, in order."""
    out: dict[str, list[int]] = {}
    for i, r in enumerate(results):
        out.setdefault(r.metric, []).append(i)
    return out


def compact_summary(title: str, results: list[Estimate], primary: str = "did", kind: str = "superiority", margin: float = 0.0, alpha: float = 0.05, artifact: str | None = None, visuals: str | None = None) -> dict[str, Any]:
    """The least a program needs: each metric's primary estimate, status and evidence, and where the rest is."""
    groups = []
    for metric, places in metric_groups(results).items():
        rows = [results[i] for i in places]
        main = next((r for r in rows if r.estimator == primary), rows[0])
        evidence = {k: v for k, v in decision_evidence(rows, kind, margin, alpha).items() if k != "rows"}
        groups.append({"metric": metric, "estimator": main.estimator, "estimate": main.estimate, "interval": main.interval, "p_value": main.p_value, "lift": main.relative_lift, "status": decision_status(main, kind, margin, alpha), "evidence": evidence, "results": places})
    return clean({"title": title, "groups": groups, "errors": [r.error for r in results if r.error], "artifact": artifact, "visuals": visuals})


def top_weights(weights: dict[str, float], most: int = 10) -> list[tuple[str, float]]:
    """The largest donor weights by size."""
    return sorted(((k, v) for k, v in weights.items() if v), key=lambda x: (-abs(x[1]), x[0]))[:most]


def write_visuals(path: str, source: str, series: dict[str, Any]) -> str:
    """Chart series in a file beside the results they belong to."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(clean({"source": source, "series": series})))
    return path


def load_analysis(path: str) -> dict[str, Any]:
    """Results with the chart series of the file they name, or of ``<name>.visuals.json`` beside them."""
    payload = json.loads(Path(path).read_text())
    beside = Path(payload.get("visuals") or Path(path).with_suffix(".visuals.json"))
    if not beside.is_absolute():
        beside = Path(path).parent / beside
    return {**payload, "series": json.loads(beside.read_text())["series"] if beside.exists() else payload.get("series", {})}


def mde_rows(candidates: DataFrame) -> DataFrame:
    """``candidate_id, metric, mde``: one row for each detectable effect."""
    return candidates.select("candidate_id", F.explode("metric_mde").alias("metric", "mde"))


def candidate_effects(candidates: DataFrame) -> DataFrame:
    """``candidate_id, best, worst, metrics``: the least and the largest detectable effect of each candidate."""
    return mde_rows(candidates).groupBy("candidate_id").agg(F.min("mde").alias("best"), F.max("mde").alias("worst"), F.count(F.lit(1)).alias("metrics"))


def candidate_summary(c: Candidate, selected: bool = True, decision_metric: str | None = None) -> dict[str, Any]:
    mde = {k[4:]: v for k, v in c.components.items() if k.startswith("mde:")}
    return {"candidate_id": c.candidate_id, "test_name": c.test_name, "start": c.start, "end": c.end, "days": (c.end - c.start).days + 1, "treated": len(c.treatment), "control": len(c.control), "score": c.score, "best_mde": min(mde.values(), default=None), "worst_mde": max(mde.values(), default=None), "decision_mde": mde.get(decision_metric) if decision_metric else None, "selected": selected}


def planning_payload(title: str, solution: dict[str, Any], candidates: list[Candidate], volume: dict[str, float] | None = None, pre_days: int = 56) -> dict[str, Any]:
    """A plan with all its candidates, the detectable effects and, where known, the treated share of the volume."""
    chosen = {c.candidate_id for c in solution["selected"]}
    total = sum((volume or {}).values())
    rows = [{**candidate_summary(c, c.candidate_id in chosen), "volume_share": sum(volume.get(m, 0.0) for m in c.treatment) / total if total else None} for c in candidates]
    effects = [{"candidate_id": c.candidate_id, "metric": k[4:], "mde": v} for c in candidates for k, v in sorted(c.components.items()) if k.startswith("mde:")]
    return clean({"title": title, "objective": solution["objective"], "optimal": solution["optimal"], "candidates": rows, "effects": effects, "unselected": solution["unselected"], "pre_period_days": pre_days})
