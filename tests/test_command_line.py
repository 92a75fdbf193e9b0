import json

import pytest

from lattiq.__main__ import main, parser
from lattiq.errors import ContractError
from tests.test_runs import COLUMNS, series


def test_runs_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    for name in ("PROJECT_DATA_ROOT", "PROJECT_RUNS_ROOT"):
        monkeypatch.delenv(name, raising=False)
    _, files, config = series(tmp_path)
    master = files["master"][1].columns
    config |= {"paths": {"data_root": ".", "runs_root": "runs"}, "files": {"records": {"path": "q.txt", "columns": list(COLUMNS)}, "master": {"path": "m.txt", "columns": list(master), "rows": 2}}}
    (tmp_path / "p.json").write_text(json.dumps(config))
    at = ["--project", str(tmp_path / "p.json"), "--root", str(tmp_path)]
    m = main(["build", *at], spark)
    assert json.loads(capsys.readouterr().out)["run_id"] == m["run_id"] and (tmp_path / "runs" / m["run_id"] / "manifest.json").exists()
    assert main(["baselines", *at], spark)["source_run"] == m["run_id"]
    (tmp_path / "f.json").write_text("{}")
    with pytest.raises(ContractError):
        main(["final", *at, "--final", str(tmp_path / "f.json")], spark)
    with pytest.raises(SystemExit):
        parser().parse_args(["other"])
