"""Runs of several stages: a checked plan, a ledger of what each stage did, and a manifest of what the run left."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.sinks import write_report


def load_plan(path: str) -> list[dict]:
    """The stages of a JSON plan, each with a name of its own and a query; anything else is refused."""
    stages = json.loads(Path(path).read_text())["stages"]
    names = [s.get("name") for s in stages]
    if not stages or None in names or len(set(names)) < len(names) or any("query" not in s for s in stages):
        raise ValueError("a plan needs stages, each with its own name and a query")
    return stages


def run_plan(spark: SparkSession, plan: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], sf_dir: str, folder: str) -> list[dict]:
    """Run the stages in order into ``folder`` (on the driver's disk); a stage that is there with the same plan isn't run again, a failing one
    ends the run with its ledger written. Returns the ledger."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    ledger_at = out / "ledger.json"
    ledger = json.loads(ledger_at.read_text()) if ledger_at.exists() else []
    done = {e["name"]: e for e in ledger if e["status"] == "done"}
    ledger = []
    for stage in load_plan(plan):
        mark = hashlib.sha256(json.dumps(stage, sort_keys=True).encode()).hexdigest()
        if stage["name"] in done and done[stage["name"]]["plan_sha256"] == mark:
            ledger.append(done[stage["name"]])
            continue
        entry = {"name": stage["name"], "plan_sha256": mark, "began": time.time(), "status": "failed"}
        ledger.append(entry)
        try:
            write_report(queries[stage["query"]](spark, sf_dir), f"{folder}/{stage['name']}", stage.get("format", "parquet"))
            entry["status"] = "done"
        finally:
            entry["seconds"] = round(time.time() - entry["began"], 3)
            ledger_at.write_text(json.dumps(ledger, indent=1))
    manifest(folder)
    return ledger


def manifest(folder: str) -> dict[str, str]:
    """sha256 of every file of a run, also written as manifest.json."""
    found = {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(Path(folder).rglob("*")) if p.is_file() and p.name != "manifest.json"}
    Path(folder, "manifest.json").write_text(json.dumps(found, indent=1))
    return found
