"""The registered queries with, where SQL can state it, the same result in SQL."""

from tracewell.workload import cleaning, discovery, inventory, learning, prediction, profiling, schema, scans, sequences
from tracewell.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

_MODULES = (scans, inventory, schema, cleaning, profiling, sequences, discovery, learning, prediction)
