"""The registered queries."""

from suite import analysis_queries, graph_queries, scope_queries, text_queries  # noqa: F401
from suite.base import ORACLES, QUERIES  # noqa: F401
from suite.graph_queries import flagship  # noqa: F401
