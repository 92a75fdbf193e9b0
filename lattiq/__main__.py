"""``python -m lattiq RUN --project project.json``: the four runs from the command line.

The project config names its raw files::

    "files": {"records": {"path": "raw/q.txt", "columns": [...], "delimiter": "|", "rows": 123, "sha256": "..."}, "master": {...}},
    "names": {"unit_id": "UNIT_ID", ...}

Paths are relative to ``--root`` or to the folders that PROJECT_DATA_ROOT and PROJECT_RUNS_ROOT name.
"""

from __future__ import annotations

import argparse
import json

from lattiq.operators.rollup import RAW
from lattiq.plans import lineage, runs
from lattiq.sources.delimited import FileSpec


def raw_files(config: dict, data_root: str) -> tuple[dict[str, tuple[str, FileSpec]], dict[str, str]]:
    """Paths and declarations of the raw files, and the columns that hold the operators' fields."""
    files = {}
    for name in ("records", "master"):
        declared = dict(config["files"][name])
        path = lineage.under(data_root, declared.pop("path"))
        spec = {{"bytes": "bytes_"}.get(k, k): v for k, v in declared.items()}
        files[name] = (path, FileSpec(**spec | {"columns": tuple(spec["columns"])}))
    return files, {c: config.get("names", {}).get(c, c.upper()) for c in RAW}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattiq", description=__doc__.split("\n", maxsplit=1)[0])
    p.add_argument("run", choices=["build", "baselines", "selection", "final"])
    p.add_argument("--project", default="configs/project.json", help="the project's config")
    p.add_argument("--candidate", default="configs/candidate.json", help="for selection: the candidate's config")
    p.add_argument("--final", default="configs/final.json", help="for final: the locked procedure's config")
    p.add_argument("--audit", help="for baselines: a JSON file of frozen figures, a list of [model, horizon, scored cells, WAPE in per cent, median MASE]")
    p.add_argument("--root", default=".", help="what relative paths start from")
    p.add_argument("--open-holdout", action="store_true", help="for final: open the holdout, which can be done once")
    return p


def main(argv: list[str] | None = None, spark=None) -> dict:
    a = parser().parse_args(argv)
    config = lineage.load_config(a.project, required=("evaluation",))
    paths = lineage.resolve_paths(config, a.root)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lattiq").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    where = {"runs_root": paths["runs_root"], "root": a.root}
    if a.run == "build":
        files, names = raw_files(config, paths["data_root"])
        m = runs.build_dataset(spark, config, files, names=names, **where)
    elif a.run == "baselines":
        m = runs.run_baselines(spark, config, audit=lineage.load_audit(a.audit) if a.audit else None, **where)
    elif a.run == "selection":
        m = runs.run_selection(spark, config, lineage.load_config(a.candidate, required=("procedure_id", "alphas", "selection_origins", "confirmation_origins", "features", "bootstrap")), **where)
    else:
        final = lineage.load_config(a.final, required=("procedure_id", "models_by_horizon", "development_calibration_origins", "holdout_origins", "latest_forecast", "intervals", "reporting"))
        m = runs.run_final(spark, config, final, open_holdout=a.open_holdout, **where)
    said = {"run_id": m["run_id"], "manifest_path": m["manifest_path"], "outputs": {k: {"path": v["path"], "rows": v["rows"]} for k, v in m["outputs"].items()}}
    print(json.dumps(said | ({"mode": m["mode"]} if "mode" in m else {}), indent=2))
    return m


if __name__ == "__main__":
    main()
