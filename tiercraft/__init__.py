"""tiercraft: Spark-native record segmentation.

Reads a table of valued records, quarantines rows with bad identity, parses
money text, imputes and standardises values, labels each row with a segment
(quantile cut of value against recency or leverage), compares with a prior
period, and produces rollups, bands, Pareto tables, top-k lists, worklists,
health reports and per-row explanations -- all as lazy Spark DataFrames.
"""

from tiercraft.config import COMPANIES, CUSTOM, PLAYERS, ModeConfig
from tiercraft.session import build_session, ensure_checkpoint_dir

__all__ = ["ModeConfig", "PLAYERS", "COMPANIES", "CUSTOM", "build_session",
           "ensure_checkpoint_dir"]
