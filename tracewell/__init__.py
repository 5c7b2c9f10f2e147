"""Event-log analytics on Spark DataFrames: clean, profile, discover, predict."""

from tracewell.log import EventLog

__all__ = ["EventLog"]
