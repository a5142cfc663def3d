"""Sales and finance analytics over invoice lines, as Spark DataFrame jobs."""

from invoicelens.plans.catalogue import indicator_names, run_indicator
from invoicelens.session import build_session

__all__ = ["build_session", "indicator_names", "run_indicator"]
