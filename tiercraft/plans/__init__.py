"""Plans: mode runners (quarantine -> clean -> segment -> trend -> rollups),
the SQL box over results, and the summary report."""

from tiercraft.plans.runner import RunResult, run_companies, run_custom, run_players
from tiercraft.plans.sql import run_sql, default_query

__all__ = ["RunResult", "run_players", "run_companies", "run_custom", "run_sql",
           "default_query"]
