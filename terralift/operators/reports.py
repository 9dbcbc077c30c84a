"""Series, calendars and self-contained reports."""

from __future__ import annotations

import html
import json
import math
from dataclasses import asdict, is_dataclass
from datetime import date
from pathlib import Path
from string import Template
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralift.operators.estimators import Estimate, consensus
from terralift.operators.panel import GeoPanel


def calendar_cells(rows: DataFrame) -> DataFrame:
    """``geo_id, week, state, tests``: what each market does in each week (from Monday); treatment goes first."""
    weeks = F.explode(F.sequence(F.trunc("start_date", "week"), F.trunc("end_date", "week"), F.expr("interval 7 days"))).alias("week")
    w = rows.select("geo_id", "test_id", "role", weeks)
    return w.groupBy("geo_id", "week").agg(F.when(F.bool_or(F.col("role") == "treatment"), "treatment").otherwise("control").alias("state"), F.array_join(F.sort_array(F.collect_set("test_id")), ",").alias("tests"))


def calendar_events(candidates: DataFrame, pre_days: int = 28, cooldown_days: int = 28) -> DataFrame:
    """``test_id, geo_id, kind, start_date, end_date``: pre-period, live and cooldown events of each market."""
    live = candidates.select("test_id", F.explode(F.array_union("treatment_markets", "control_markets")).alias("geo_id"), "start_date", "end_date")
    event = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start_date"), b.alias("end_date"))
    s, e = F.col("start_date"), F.col("end_date")
    made = F.explode(F.array(event("pre", F.date_sub(s, pre_days), F.date_sub(s, 1)), event("live", s, e), event("cooldown", F.date_add(e, 1), F.date_add(e, cooldown_days)))).alias("x")
    return live.select("test_id", "geo_id", made).select("test_id", "geo_id", "x.*")


def binned_series(panel: GeoPanel, treated: list[str], column: str, start: date, days: int = 7) -> DataFrame:
    """``bin, treatment, control``: mean over markets of the daily mean in bins from the test's start; before it 100."""
    at = F.floor(F.datediff(F.to_date(F.col(panel.time)), F.lit(start)) / days).cast("int").alias("bin")
    x = panel.df.groupBy(at, F.col(panel.geo).alias("geo")).agg((F.sum(column) / F.count_distinct(panel.time)).alias("v"))
    z = F.col("geo").isin(treated)
    a = x.groupBy("bin").agg(F.avg(F.when(z, F.col("v"))).alias("treatment"), F.avg(F.when(~z, F.col("v"))).alias("control"))
    everything = Window.partitionBy()
    one = lambda c: 100 * F.col(c) / F.avg(F.when(F.col("bin") < 0, F.col(c))).over(everything)
    return a.select("bin", one("treatment").alias("treatment"), one("control").alias("control"))


def clean(value: Any) -> Any:
    """JSON-ready: infinities and NaN become null."""
    if is_dataclass(value) and not isinstance(value, type):
        return clean(asdict(value))
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [clean(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, date):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def validity_checks(e: Estimate) -> list[dict[str, str]]:
    """Flags from an estimate's diagnostics."""
    d, out = e.diagnostics, []

    def add(name: str, value: float | None, warn: float, fail: float) -> None:
        if value is not None:
            out.append({"check": name, "status": "fail" if value > fail else "warning" if value > warn else "ok"})

    add("parallel_trends", d.get("relative_gap_slope"), 0.1, math.inf)
    add("pre_fit", d.get("relative_rmse"), 0.1, 0.3)
    add("donor_concentration", d.get("hhi"), 0.35, 0.6)
    if e.interval and all(map(math.isfinite, e.interval)) and e.estimate:
        add("interval_width", (e.interval[1] - e.interval[0]) / abs(e.estimate), 6, math.inf)
    return out


def decision_status(e: Estimate, framework: str = "superiority", margin: float = 0.0, alpha: float = 0.05) -> str:
    """Status of a primary estimate under its framework; margins count as minus their size for non-inferiority."""
    if e.error or not math.isfinite(e.estimate):
        return "not_estimable"
    if e.interval is None:
        return "no_interval"
    low, high = e.interval
    m = abs(margin)
    if framework == "non_inferiority":
        return "supported" if low > -m else "rejected" if high < -m else "inconclusive"
    if framework == "equivalence":
        return "supported" if low > -m and high < m else "rejected" if low > m or high < -m else "inconclusive"
    significant = e.p_value is not None and e.p_value <= alpha
    if framework == "inferiority":
        return "supported" if high < m else "rejected" if low > m else "inconclusive"
    if framework == "two_sided":
        return "supported" if significant else "inconclusive"
    return "supported" if significant and e.estimate > 0 else "rejected" if significant else "inconclusive"


def analysis_payload(title: str, results: list[Estimate], primary: str = "did", framework: str = "superiority", margin: float = 0.0, alpha: float = 0.05) -> dict[str, Any]:
    by: dict[str, list[Estimate]] = {}
    for r in results:
        by.setdefault(r.metric, []).append(r)
    groups = []
    for metric, rows in by.items():
        main = next((r for r in rows if r.estimator == primary), rows[0])
        groups.append({"metric": metric, "status": decision_status(main, framework, margin, alpha), "consensus": consensus(rows), "results": rows, "checks": {r.estimator: validity_checks(r) for r in rows}})
    return clean({"title": title, "groups": groups})


PAGE = Template("""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>$title</title>
<style>body{font:15px sans-serif;max-width:60em;margin:2em auto}td,th{padding:.3em .8em;border-bottom:1px solid #ccc;text-align:right}td:first-child,th:first-child{text-align:left}</style></head>
<body><h1>$title</h1>$body<script type="application/json" id="data">$data</script></body></html>""")


def table(header: list[str], rows: list[list[Any]]) -> str:
    cell = lambda v, t: f"<{t}>{html.escape('' if v is None else f'{v:.4g}' if isinstance(v, float) else str(v))}</{t}>"
    return "<table><tr>" + "".join(cell(h, "th") for h in header) + "</tr>" + "".join("<tr>" + "".join(cell(v, "td") for v in r) + "</tr>" for r in rows) + "</table>"


def render_analysis(payload: dict[str, Any], path: str) -> str:
    """One self-contained HTML file with the results and their data."""
    parts = []
    for g in payload["groups"]:
        rows = [[r["estimator"], r["estimate"], *(r["interval"] or [None, None]), r["p_value"], r["relative_lift"], r["error"]] for r in g["results"]]
        parts.append(f"<h2>{html.escape(g['metric'])}: {g['status']}</h2>" + table(["estimator", "estimate", "low", "high", "p", "lift", "error"], rows))
    return _write(path, payload["title"], "".join(parts), payload)


def render_plan(title: str, solution: dict[str, Any], path: str) -> str:
    rows = [[c["test_name"], c["candidate_id"], c["start"], c["end"], len(c["treatment"]), len(c["control"]), c["score"]] for c in clean(solution["selected"])]
    body = table(["test", "candidate", "start", "end", "treated", "control", "score"], rows) + f"<p>Objective {solution['objective']:.3f}; not placed: {html.escape(', '.join(solution['unselected']) or 'none')}.</p>"
    return _write(path, title, body, clean(solution))


def _write(path: str, title: str, body: str, data: Any) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(PAGE.substitute(title=html.escape(title), body=body, data=json.dumps(data).replace("</", "<\\/")))
    return path
