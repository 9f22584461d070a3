"""Named queries (Spark) and their DuckDB oracles, feeding ``__spark_entry__``."""

from .registry import ORACLES, QUERIES
from . import q_text, q_select, q_sets, q_io, q_prep  # noqa: F401  (registration side effects)

__all__ = ["QUERIES", "ORACLES"]
