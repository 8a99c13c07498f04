"""The registered queries; importing this package registers them."""

from tessera.plans import decision_queries, join_queries, metric_queries, model_queries, scalar_queries, stream_queries, summary_queries, window_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
