"""Training-data operators: search, joins, tokens, models and packing over a corpus of documents.

``LLM_QUERIES`` and ``LLM_ORACLES`` hold the registered queries and their SQL. Nothing else in the
library imports this package.
"""

from tracewell.llm.queries import LLM_ORACLES, LLM_QUERIES

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
