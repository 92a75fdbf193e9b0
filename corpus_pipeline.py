"""The corpus pipeline at the place where the driver looks for it; its stages are in ``lattiq.llm.pipeline``."""

from lattiq.llm.pipeline import ORACLE_SQL, STAGES, oracle_sql, queries, run

__all__ = ["ORACLE_SQL", "STAGES", "oracle_sql", "queries", "run"]
