"""Commands: validate panels and configurations, make data, plan, monitor, analyse."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from terralift.operators import portfolio, reports
from terralift.operators.analysis import analyze, methodology_status
from terralift.operators.candidates import Generator
from terralift.operators.panel import GeoPanel
from terralift.operators.registry_store import ExperimentRegistry
from terralift.operators.report_payloads import compact_summary, load_analysis
from terralift.operators.specs import MODELS, CompletedSpec, RoadmapSpec, read_config
from terralift.sources.synthetic import Lift, apply_lift, generate_panel


def session() -> SparkSession:
    return SparkSession.builder.appName("terralift").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def panel_of(args: argparse.Namespace, validate: bool = True) -> GeoPanel:
    return GeoPanel.from_parquet(session(), args.panel, geo=args.geo, time=args.time, validate=validate)


def write(path: str | None, payload: Any) -> None:
    text = json.dumps(reports.clean(payload), indent=2, default=str)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
    else:
        print(text)


def validate_panel(args: argparse.Namespace) -> int:
    report = panel_of(args, validate=False).validate(complete=args.complete)
    write(args.out, report)
    return 0 if report.valid else 1


def validate_roadmap(args: argparse.Namespace) -> int:
    spec = RoadmapSpec.from_file(args.config)
    write(args.out, {"name": spec.name, "tests": [t.name for t in spec.tests], "valid": True})
    return 0


def validate_completed(args: argparse.Namespace) -> int:
    write(args.out, {"experiment_id": CompletedSpec.from_file(args.config).experiment_id, "valid": True})
    return 0


def registry_import(args: argparse.Namespace) -> int:
    write(args.out, ExperimentRegistry(session(), args.registry).import_assignments(args.source, dry_run=args.dry_run))
    return 0


def synthetic(args: argparse.Namespace) -> int:
    generate_panel(session(), args.markets, args.start, args.periods, seed=args.seed, us=args.us).write.mode("overwrite").parquet(args.out)
    return 0


def candidates(args: argparse.Namespace) -> int:
    spec = RoadmapSpec.from_file(args.config)
    write(args.out, Generator(spec, panel_of(args)).generate(args.most))
    return 0


def solve(args: argparse.Namespace) -> int:
    spec = RoadmapSpec.from_file(args.config)
    registry = ExperimentRegistry(session(), args.registry) if args.registry else None
    made = Generator(spec, panel_of(args), registry).generate(args.most)
    cap = spec.max_shared_control_usage if spec.allow_shared_controls else 1
    found = portfolio.solve([c for cs in made.values() for c in cs], spec.control_overuse_penalty, cap, seconds=args.seconds)
    write(args.out, found)
    if args.report:
        reports.render_plan(spec.name, found, args.report)
    if args.out and args.manifest:
        portfolio.write_manifest(args.manifest, "plan", [args.out, *([args.report] if args.report else [])], [args.config])
    return 0


def report_plan(args: argparse.Namespace) -> int:
    reports.render_plan(args.title, json.loads(Path(args.plan).read_text()), args.out)
    return 0


def monitor(args: argparse.Namespace) -> int:
    plan = json.loads(Path(args.plan).read_text())
    rows = [(c["test_name"], c.get("status", "planned"), date.fromisoformat(c["start"]), date.fromisoformat(c["end"]), sorted(c["treatment"]), sorted(c["control"]), c.get("calibrated_power")) for c in plan["selected"]]
    items = session().createDataFrame(rows, "test_id string, status string, start_date date, end_date date, treatment_markets array<string>, control_markets array<string>, calibrated_power double")
    summary = portfolio.monitor(items, date.fromisoformat(args.as_of), target=args.target_power)
    out = {"summary": summary, "actions": portfolio.recommend(summary)}
    if args.previous:
        out["changes"] = portfolio.difference(json.loads(Path(args.previous).read_text())["summary"], summary)
    write(args.out, out)
    return 0


def analysis(args: argparse.Namespace) -> int:
    spec = completed(args.config)
    found = analyze(lifted(panel_of(args), args.config), spec, args.estimators)
    write(args.out, {**found.payload, "adjusted": found.adjusted, "monitoring": found.monitoring, "calibration": found.calibration, "status": methodology_status(found)})
    if args.report:
        reports.render_analysis(found.payload, args.report)
    return 0


def lifted(panel: GeoPanel, config: str) -> GeoPanel:
    """The panel with the lift that a completed test's file names under ``synthetic_lift``, if any."""
    raw = read_config(config)
    lift = raw.get("synthetic_lift") if isinstance(raw, dict) else None
    if not lift:
        return panel
    made = Lift(tuple(lift.get("markets") or raw["treatment"]), str(lift.get("start", raw["start"])), str(lift.get("end", raw["end"])), float(lift["lift"]), lift["metric"], lift.get("mode", "relative"))
    return replace(panel, df=apply_lift(panel.df, made, panel.geo, panel.time))


def completed(path: str) -> CompletedSpec:
    raw = read_config(path)
    return CompletedSpec.model_validate({k: v for k, v in raw.items() if k != "synthetic_lift"})


def analyze_portfolio(args: argparse.Namespace) -> int:
    """Every completed test over one panel, and a table of their decisions."""
    table, folder = [], Path(args.artifacts) if args.artifacts else None
    for path in args.configs:
        spec = completed(path)
        found = analyze(lifted(panel_of(args), path), spec, args.estimators)
        table += [{"test_id": spec.experiment_id, **{k: g[k] for k in ("metric", "estimator", "estimate", "p_value", "status")}} for g in compact_summary(spec.experiment_id, found.results, spec.primary_estimator, spec.framework, spec.margin, spec.alpha)["groups"]]
        if folder:
            write(str(folder / f"{spec.experiment_id}.json"), found.payload)
    write(args.out, {"decisions": table})
    return 0


def report_analysis(args: argparse.Namespace) -> int:
    reports.render_analysis(load_analysis(args.results), args.out)
    return 0


def schema(args: argparse.Namespace) -> int:
    write(args.out, MODELS[args.model].model_json_schema())
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="terralift", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run: Any, *arguments: tuple[Any, ...], panel: bool = False) -> None:
        p = sub.add_parser(name, help=run.__name__)
        if panel:
            p.add_argument("panel")
            p.add_argument("--geo", default="geo_id")
            p.add_argument("--time", default="date")
        for flags, how in arguments:
            p.add_argument(*flags, **how)
        if not any("--out" in a[0] or "out" in a[0] for a in arguments):
            p.add_argument("--out")
        p.set_defaults(run=run)

    config = (("config",), {})
    most = (("--most",), {"type": int, "default": 8})
    command("validate-panel", validate_panel, (("--complete",), {"action": "store_true"}), panel=True)
    command("validate-roadmap", validate_roadmap, config)
    command("validate-completed", validate_completed, config)
    command("registry-import", registry_import, (("source",), {}), (("registry",), {}), (("--dry-run",), {"action": "store_true"}))
    command("synthetic", synthetic, (("out",), {}), (("--markets",), {"type": int, "default": 100}), (("--start",), {"default": "2027-01-01"}), (("--periods",), {"type": int, "default": 730}), (("--seed",), {"type": int, "default": 2027}), (("--us",), {"action": "store_true"}))
    command("candidates", candidates, config, most, panel=True)
    command("solve", solve, config, most, (("--registry",), {}), (("--report",), {}), (("--manifest",), {}), (("--seconds",), {"type": float, "default": 30.0}), panel=True)
    command("report-plan", report_plan, (("plan",), {}), (("out",), {}), (("--title",), {"default": "Plan"}))
    command("monitor", monitor, (("plan",), {}), (("--previous",), {}), (("--as-of",), {"required": True}), (("--target-power",), {"type": float, "default": 0.8}))
    command("analyze-portfolio", analyze_portfolio, (("configs",), {"nargs": "+"}), (("--artifacts",), {}), (("--estimators",), {"nargs": "*"}), panel=True)
    command("report-analysis", report_analysis, (("results",), {}), (("out",), {}))
    command("schema", schema, (("model",), {"choices": sorted(MODELS)}))
    command("analyze", analysis, config, (("--report",), {}), (("--estimators",), {"nargs": "*"}), panel=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
