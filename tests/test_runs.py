import json

import pytest

from lattiq.errors import ContractError, HoldoutError, SelectionError
from lattiq.functions.periods import quarters
from lattiq.functions.text import to_double, to_int
from lattiq.operators.rollup import RAW, entity_quarters, typed_records, unit_quarters
from lattiq.plans import lineage as N
from lattiq.plans import runs
from lattiq.plans.holdout import Ledger
from lattiq.sources.delimited import FileSpec, bad_lines, inspect_splits, inspect_unquoted, read_header, same_file, scan, validate_raw_file
from lattiq.sources.files import sha256_of
from lattiq.sources.sinks import content_hash, publish

COLUMNS = tuple(c.upper() for c in RAW)
NAMES = {c: c.upper() for c in RAW}


def write(path, rows, columns=COLUMNS):
    text = "\r\n".join("|".join(f'"{v}"' for v in r) for r in [columns, *rows]) + "\r\n"
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def record(unit, entity, sub, year, quarter, value, domain="C"):
    return [unit, "Mine é|x", entity, sub, year, quarter, "5", "10", value, domain]


@pytest.fixture
def small(tmp_path):
    rows = [record("1", "al", "A", 2020, 1, "10"), record("1", "AL", "B", 2020, 1, ""), record("2", "AL", "A", 2020, 1, "0"), record("3", "WV", "A", 2020, 2, ""), record("4", "WV", "A", 2020, 2, "7", "M")]
    return {"records": (write(tmp_path / "q.txt", rows), FileSpec(COLUMNS)), "master": (write(tmp_path / "m.txt", [["1", "AL", "C"], ["2", "AL", "C"], ["3", "WV", "C"]], ("UNIT_ID", "ENTITY", "DOMAIN")), FileSpec(("UNIT_ID", "ENTITY", "DOMAIN")))}


OK = {"raw_quarterly_rows": 5, "domain_source_rows": 4, "duplicate_source_keys": 0, "invalid_unit_ids": 0, "unit_quarter_rows": 3, "unit_quarter_all_null_rows": 1, "unmatched_unit_ids": 0}


def test_build_keeps_nulls_and_publishes(spark, small, tmp_path):
    config = {"quality_expectations": OK}
    m = runs.build_dataset(spark, config, small, tmp_path / "runs", names=NAMES)
    t = N.load_outputs(spark, tmp_path / "runs", m)
    u = {(r.unit_id, r.period): (r.value, r.all_null, r.partly_null) for r in t["unit_quarter"].collect()}
    assert u == {("1", "2020Q1"): (10.0, False, True), ("2", "2020Q1"): (0.0, False, False), ("3", "2020Q2"): (None, True, False)}
    e = {(r.entity, r.period): r.value for r in t["entity_quarter"].collect()}
    assert e == {("AL", "2020Q1"): 10.0, ("WV", "2020Q2"): None}
    assert N.latest_manifest(spark, tmp_path / "runs", stage="build", config=config)["run_id"] == m["run_id"]
    again = runs.build_dataset(spark, config, small, tmp_path / "other", names=NAMES)
    assert again["outputs"]["unit_quarter"]["content_sha256"] == m["outputs"]["unit_quarter"]["content_sha256"]
    with open(small["records"][0], "ab") as f:
        f.write(b" ")
    with pytest.raises(ContractError):
        N.latest_manifest(spark, tmp_path / "runs", stage="build", config=config)


def test_bad_rows_block(spark, small, tmp_path):
    rows = [record("1", "AL", "A", 2020, 1, "-1"), record("1", "AL", "A", 2020, 1, "x"), record("b", "AL", "A", 2020, 5, "1")]
    files = small | {"records": (write(tmp_path / "b.txt", rows), FileSpec(COLUMNS))}
    with pytest.raises(ContractError, match="duplicate_source_keys, invalid_periods, invalid_unit_ids, invalid_values, negative_value_rows"):
        runs.build_dataset(spark, {"quality_expectations": {"duplicate_source_keys": 0, "invalid_periods": 0, "invalid_unit_ids": 0, "invalid_values": 0, "negative_value_rows": 0}}, files, tmp_path / "r", names=NAMES)


def test_raw_contract(spark, tmp_path):
    spec = FileSpec(("A", "B"), quote="", rows=2)
    p = tmp_path / "u.txt"
    p.write_bytes(b"A|B\n1|before \x8f after\n2\n")
    assert inspect_unquoted(p, spec)["first_bad_lines"] == [3] and bad_lines(spark, str(p), spec).count() == 1
    with pytest.raises(ContractError):
        validate_raw_file(spark, p, spec)
    p.write_bytes(b"A|B\n1|before \x8f after\n2|\n")
    assert validate_raw_file(spark, p, spec)["status"] == "passed" and read_header(spark, str(p), spec) == ["A", "B"]
    assert [r.B for r in scan(spark, str(p), spec).orderBy("A").collect()] == ["before \x8f after", None]
    for bad in (FileSpec(("A", "C"), quote=""), FileSpec(("A", "B"), quote="", bytes_=1), FileSpec(("A", "B"), quote="", sha256="0")):
        with pytest.raises(ContractError):
            validate_raw_file(spark, p, bad)
    (tmp_path / "e.txt").write_text("")
    with pytest.raises(ContractError):
        read_header(spark, str(tmp_path / "e.txt"), spec)
    with pytest.raises(ContractError):
        validate_raw_file(spark, tmp_path / "gone.txt", spec)


def test_a_file_in_many_splits_is_inspected_as_in_one_pass(spark, tmp_path):
    lines = [f"{i}|é \x8f {'x' * (i * 7 % 90)}" + ("|" if i % 701 == 3 else "") for i in range(4000)]
    p = tmp_path / "u.txt"
    spec = FileSpec(("A", "B"), quote="")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    seen = set()
    try:
        for end in ("\n", ""):
            p.write_bytes(("A|B\n" + "\n".join(lines) + end).encode("latin-1"))
            want = inspect_unquoted(p, spec)
            for size in ("1g", str(p.stat().st_size // 64), "1000"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                spark.conf.set("spark.sql.files.openCostInBytes", "0")
                got = inspect_splits(spark, str(p), spec)
                assert {k: got[k] for k in want if k != "sha256"} == {k: v for k, v in want.items() if k != "sha256"} and len(want["first_bad_lines"]) == 5
                seen.add(got["fingerprint"])
            assert sha256_of(spark, str(p)) == want["sha256"]
        lines[5], lines[6] = lines[6], lines[5]
        p.write_bytes(("A|B\n" + "\n".join(lines)).encode("latin-1"))
        assert len(seen) == 1 and inspect_splits(spark, str(p), spec)["fingerprint"] not in seen  # order counts
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_a_declared_fingerprint_stands_for_the_hash(spark, tmp_path):
    p = tmp_path / "u.txt"
    p.write_bytes(b"A|B\n1|2\n")
    mark = inspect_splits(spark, str(p), FileSpec(("A", "B"), quote=""))["fingerprint"]
    for quote in ("", '"'):
        record = validate_raw_file(spark, p, FileSpec(("A", "B"), quote=quote, fingerprint=mark))
        assert "sha256" not in record and same_file(spark, record)
        assert same_file(spark, record | {"modified": 0}) and not same_file(spark, record | {"modified": 0, "fingerprint": "0"}) and not same_file(spark, record | {"bytes": 1})
    with pytest.raises(ContractError, match="another fingerprint"):
        validate_raw_file(spark, p, FileSpec(("A", "B"), fingerprint="0"))


def test_number_text(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("1.5",), ("12d",), ("1_000",), ("nan",), (" 7 ",), ("",), ("-3e2",)], "s string").select(to_double(F.col("s")), to_int(F.col("s")))
    assert [tuple(r) for r in d.collect()] == [(1.5, 2), (None, None), (1000.0, 1000), (None, None), (7.0, 7), (None, None), (-300.0, -300)]


def test_publish_refuses_and_checks(spark, tmp_path):
    d = spark.range(5)
    publish(d, str(tmp_path / "t"), ["id"])
    with pytest.raises(ContractError):
        publish(d, str(tmp_path / "t"), ["id"])
    with pytest.raises(ContractError):
        publish(d, str(tmp_path / "u"), ["id"], rows=4)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    assert content_hash(d) == content_hash(spark.range(5).repartition(3)) != content_hash(spark.range(6))


def test_configs_and_paths(tmp_path, monkeypatch):
    assert N.config_hash({"a": 1, "_note": 2}) == N.config_hash({"_note": 3, "a": 1}) != N.config_hash({"a": 2})
    monkeypatch.setenv("PROJECT_DATA_ROOT", str(tmp_path / "d"))
    assert N.resolve_paths({"paths": {"runs_root": "r"}}, tmp_path) == {"data_root": str(tmp_path / "d"), "runs_root": str(tmp_path / "r")}
    monkeypatch.setenv("PROJECT_RUNS_ROOT", "s3a://bucket/x")
    assert N.resolve_paths({}, tmp_path)["runs_root"] == "s3a://bucket/x" and N.under("hdfs://h/a/", "./b") == "hdfs://h/a/b" and N.under(".", "b") == "b"
    (tmp_path / "c.json").write_text(json.dumps({"a": 1}))
    with pytest.raises(ContractError):
        N.load_config(tmp_path / "c.json", required=("b",))
    with pytest.raises(ContractError):
        N.load_config(tmp_path / "c.json", frozen={"a": 2})


def test_holdout_opens_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    with pytest.raises(HoldoutError):
        ledger.admit("x", consent=False, passed=None)
    with pytest.raises(HoldoutError):
        ledger.settle("x", "r")
    assert ledger.admit("x", consent=True, passed=None) is None
    for other in (("y", "r"), ("x", None)):
        with pytest.raises(HoldoutError):
            ledger.admit(other[0], consent=True, passed=other[1])
    assert ledger.admit("x", consent=False, passed="r") == "r"
    ledger.settle("x", "r")
    ledger.settle("x", "r")
    assert ledger.admit("x", consent=False, passed="r") == "r"
    for bad in (lambda: ledger.admit("x", consent=True, passed="other"), lambda: ledger.settle("x", "other"), lambda: ledger.settle("y", "r")):
        with pytest.raises(HoldoutError):
            bad()
    (tmp_path / "holdout" / "opened.json").write_text("{")
    with pytest.raises(HoldoutError):
        ledger.admit("x", consent=True, passed="r")


def test_only_one_runner_opens_the_holdout(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def run(_):
        try:
            return Ledger(spark, str(tmp_path)).admit("x", consent=True, passed=None) is None
        except HoldoutError:
            return False

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(run, range(8))) == 1


def test_candidate_config_is_frozen():
    ok = {"procedure_id": "pooled_direct_ridge_log_change_v1", "features": {"numeric": list(N.LOG), "categorical": ["entity", "target_quarter"]}, "alphas": [0.1, 1, 10, 100]}
    assert N.check_candidate_config(ok) is ok
    for bad in ({"procedure_id": "other"}, {"features": ok["features"] | {"numeric": ["log_level"]}}, {"alphas": [1.0]}, {"response": "delta"}):
        with pytest.raises(ContractError):
            N.check_candidate_config(ok | bad)


def test_artifacts_stay_in_the_runs_folder(spark, tmp_path):
    for path in ("../x.parquet", "/etc/x", "a/../../x", "hdfs://x/y"):
        with pytest.raises(ContractError, match="leaves"):
            N.artifact(spark, tmp_path, {"path": path})


def series(tmp_path):
    rows = [record(str(u), e, "A", q[:4], q[-1], 100 * u + i + (7 * i * u) % 5) for u, e in ((1, "AA"), (2, "BB")) for i, q in enumerate(quarters("2016Q1", "2023Q3"))]
    files = {"records": (write(tmp_path / "q.txt", rows), FileSpec(COLUMNS)), "master": (write(tmp_path / "m.txt", [["1", "AA", "C"], ["2", "BB", "C"]], ("UNIT_ID", "ENTITY", "DOMAIN")), FileSpec(("UNIT_ID", "ENTITY", "DOMAIN")))}
    config = {"quality_expectations": {"unit_quarter_rows": len(rows)}, "evaluation": {
        "modeling_start": "2016Q1", "forecast_horizons": [1, 2, 3, 4], "eligibility": {"minimum_non_null_history": 8, "required_consecutive_recent_observations": 4},
        "validation_origins": {"start": "2018Q4", "end": "2020Q1", "count": 6}, "holdout_origins": {"start": "2021Q2", "end": "2021Q3", "count": 2}, "scored_target_end": "2022Q3", "latest_forecast_origin": "2023Q3"}}
    return rows, files, config


def test_selection_tables(spark, tmp_path):
    rows, _, config = series(tmp_path)
    panel = entity_quarters(unit_quarters(typed_records(spark.createDataFrame([tuple(map(str, r)) for r in rows], list(RAW)))))
    candidate = {"selection_origins": {"start": "2018Q4", "end": "2019Q3", "count": 4}, "confirmation_origins": {"start": "2019Q4", "end": "2020Q1", "count": 2}, "alphas": [1.0, 100.0], "intervals": {"warmup_origins": 1, "coverages": [0.8, 0.9]}, "tie_tolerance": 10.0,
                 "bootstrap": {"block_length": 2, "replications": 20, "seed": 1}, "gates": {"wape_h1": (0, 10), "wape_h2": (5, 10)}}
    t = runs.selection_tables(panel.where("quarter <= date'2020-07-01'"), config, candidate)
    assert len(t) == 21 and {r.gate: r.met for r in t["promotion"].collect()} == {"wape_h1": True, "wape_h2": False} and t["bootstrap_skill"].count() == 5 and t["candidate_forecasts"].count() == 2 * 4 * 4 * 2
    assert [r.alpha for r in t["alpha_summary"].where("selected").collect()] == [100.0]  # within so wide a tolerance the largest
    assert {"lower_90", "upper_90"} <= set(t["selected_forecasts"].columns) and t["selected_forecasts"].where("interval_available_80").count() > 0
    assert {r.diagnostic for r in t["binned_residuals"].select("diagnostic").distinct().collect()} == {"forecast", *N.LOG}
    assert t["selected_volume_metrics"].count() > 0
    for unread in ({"intervals": {"warmup": 1}}, {"coverages": [0.8]}, {"bootstrap": {"block": 2}}):
        with pytest.raises(ContractError, match="nothing reads"):
            runs.selection_tables(panel, config, candidate | unread)
    with pytest.raises(SelectionError):
        runs.selection_tables(panel, config, candidate)


def test_final_run_opens_the_holdout_once(spark, tmp_path):
    rows, files, config = series(tmp_path)
    root = tmp_path / "runs"
    build = runs.build_dataset(spark, config, files, root, names=NAMES)
    base = runs.run_baselines(spark, config, root)
    assert base["checks"] == {"prediction_coverage": "passed", "horizon_four_equality": "passed", "holdout_opened": False, "frozen_baseline_audit": "not_requested"}
    assert base["started_at_utc"] <= base["finished_at_utc"] and base["duration_seconds"] > 0 and build["duration_seconds"] > 0
    final = {"procedure_id": "horizon_specific_naive_baseline_v1", "models_by_horizon": {"1": "persistence", "2": "persistence", "3": "seasonal_naive", "4": "persistence"}, "intervals": {"coverages": [0.8, 0.95]}, "development_calibration_origins": {"start": "2018Q4", "end": "2020Q1"},
             "holdout_origins": {"start": "2021Q2", "end": "2021Q3", "count": 2, "target_end": "2022Q3"}, "latest_forecast": {"origin": "2023Q3", "target_end": "2024Q3", "revision_status": "revisable"}, "reporting": {"operational_focus_horizons": [1, 2], "reported_horizons": [1, 2, 3, 4]}}
    with pytest.raises(HoldoutError):
        runs.run_final(spark, config, final, root)
    one = runs.run_final(spark, config, final, root, open_holdout=True)
    two = runs.run_final(spark, config, final, root, open_holdout=True)
    assert one["checks"]["holdout_closed"] and one["baseline_run"] == base["run_id"]
    assert (one["mode"], two["mode"]) == ("new", "reuse") and one["run_id"] == two["run_id"] and two["tables"]["holdout_forecasts"].count() == 2 * 2 * 4
    other = {"coverages": {"intervals": {"coverages": [0.9]}}, "mapping": {"models_by_horizon": final["models_by_horizon"] | {"3": "persistence"}}, "procedure": {"procedure_id": "mine"},
             "latest": {"latest_forecast": final["latest_forecast"] | {"origin": "2023Q2", "target_end": "2024Q2"}}, "target": {"holdout_origins": final["holdout_origins"] | {"target_end": "2022Q2"}}}
    for change in other.values():
        with pytest.raises(ContractError):
            runs.run_final(spark, config, final | change, root, open_holdout=True)


def test_diagnostics_refuse_confirmation_rows(spark):
    from lattiq.errors import DiagnosticError
    from lattiq.functions.periods import period_start
    from lattiq.operators.uncertainty import selection_only

    d = spark.createDataFrame([(period_start(q), 1.0) for q in ("2019Q2", "2019Q3")], "origin_date date, forecast double")
    assert selection_only(d, "2019Q3") is d
    with pytest.raises(DiagnosticError):
        selection_only(d, "2019Q2")


def test_selection_run_records_what_it_opened(spark, tmp_path, monkeypatch):
    rows, files, config = series(tmp_path)
    root = tmp_path / "runs"
    runs.build_dataset(spark, config, files, root, names=NAMES)
    monkeypatch.setattr(runs, "selection_tables", lambda panel, *a: {"panel": panel})
    candidate = {"procedure_id": "pooled_direct_ridge_log_change_v1", "features": {"numeric": list(N.LOG), "categorical": ["entity", "target_quarter"]}, "alphas": [0.1, 1, 10, 100], "selection_origins": {"start": "2018Q4", "end": "2019Q3", "count": 4}}
    with pytest.raises(ContractError, match="no passed run of baselines"):
        runs.run_selection(spark, config, candidate, root)
    base = runs.run_baselines(spark, config, root)
    m = runs.run_selection(spark, config, candidate, root)
    assert m["baseline_run"] == base["run_id"]
    assert m["checks"] == {"prediction_coverage": "passed", "diagnostic_gate_status": "awaiting_review", "confirmation_opened": False, "holdout_opened": False}
    with pytest.raises(ContractError):
        runs.run_selection(spark, config, candidate | {"alphas": [3.0]}, root)


def test_a_project_with_frozen_figures_needs_their_audit(spark, tmp_path):
    rows, files, config = series(tmp_path)
    config["evaluation"]["baseline_audit"] = True
    root = tmp_path / "runs"
    build = runs.build_dataset(spark, config, files, root, names=NAMES)
    base = runs.run_baselines(spark, config, root)
    with pytest.raises(ContractError, match="no passed run of baselines"):
        runs.baseline_manifest(spark, config, root, build)
    figures = [[r.model, r.horizon, r.scored_cells, round(r.wape * 100, 2), round(r.median_entity_mase, 3)] for r in N.load_outputs(spark, root, base)["metrics"].collect()]
    (tmp_path / "audit.json").write_text(json.dumps(figures))
    audited = runs.run_baselines(spark, config, root, audit=N.load_audit(tmp_path / "audit.json"))
    assert runs.baseline_manifest(spark, config, root, build)["run_id"] == audited["run_id"]
    (tmp_path / "audit.json").write_text("[1]")
    with pytest.raises(ContractError):
        N.load_audit(tmp_path / "audit.json")


def test_values_after_the_cutoff_are_not_opened(spark, tmp_path):
    from lattiq.functions.periods import period_start
    from lattiq.sources.delimited import until

    rows, files, config = series(tmp_path)
    m = runs.build_dataset(spark, config, files, tmp_path / "runs", names=NAMES)
    d = until(N.artifact(spark, tmp_path / "runs", m["outputs"]["entity_quarter"]), period_start("2017Q4"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarter" in plan and d.count() == 16
    later = [f["path"] for f in m["outputs"]["entity_quarter"]["files"] if f["path"] >= "quarter=2018"]
    for f in later:  # what is not opened may be anything
        path = tmp_path / "runs" / m["outputs"]["entity_quarter"]["path"] / m["outputs"]["entity_quarter"]["data"] / f
        path.write_bytes(b"no parquet")
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    assert later and d.count() == 16
