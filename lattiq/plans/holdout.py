"""The one-time holdout: a ledger of two entries, each of which can be written only once.

``opened`` names the procedure that may look at the holdout; ``settled`` names its run that passed.
Both are files created exclusively, so that of two runners only one opens, and what is written is
never rewritten.  Spark reads late: make the holdout's DataFrames after ``admit`` has returned.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from lattiq.errors import HoldoutError
from lattiq.sources.files import read_text, write_once


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    runs_root: str

    def entry(self, kind: str) -> dict | None:
        text = read_text(self.spark, f"{self.runs_root}/holdout/{kind}.json")
        try:
            return None if text is None else json.loads(text)
        except json.JSONDecodeError as error:
            raise HoldoutError(f"the ledger's entry {kind!r} cannot be read") from error

    def _enter(self, kind: str, **what: str) -> bool:
        return write_once(self.spark, f"{self.runs_root}/holdout/{kind}.json", json.dumps(what | {"at": dt.datetime.now(dt.UTC).isoformat()}, sort_keys=True))

    def admit(self, procedure: str, *, consent: bool, passed: str | None) -> str | None:
        """None: the holdout is now open to the caller.  A run: it was open before, and this run's results are to be used.

        ``passed`` is the procedure's passed run, if the caller has found one.
        """
        opened = self.entry("opened")
        if opened is None and not consent:
            raise HoldoutError("nobody has asked to open the holdout")
        if opened is None and self._enter("opened", procedure=procedure):
            return None
        opened = opened or self.entry("opened")  # another runner was faster
        settled = self.entry("settled") or {"run": passed}
        faults = {
            "it is open to another procedure": opened.get("procedure") != procedure,
            "it was opened and no run of it passed": passed is None,
            "another run settled it": passed is not None and settled.get("run") != passed,
        }
        if any(faults.values()):
            raise HoldoutError("the holdout stays shut: " + "; ".join(k for k, wrong in faults.items() if wrong))
        return passed

    def settle(self, procedure: str, run: str) -> None:
        """The run that passed; again is no error if it is the same one."""
        if (self.entry("opened") or {}).get("procedure") != procedure:
            raise HoldoutError("the holdout was not opened by this procedure")
        if not self._enter("settled", procedure=procedure, run=run) and self.entry("settled").get("run") != run:
            raise HoldoutError("another run settled the holdout")
