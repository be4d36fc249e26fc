"""The corpus pipeline: quality rules, language, near copies, contamination, encoding. Its stages are in
tidepool.llm.pipeline; this module is counted as part of that subpackage."""

from tidepool.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
