"""All registered queries."""

from rankloom.workload import (  # noqa: F401
    discovery_queries,
    feed_queries,
    gap_queries,
    research_queries,
    site_queries,
    text_queries,
    topic_queries,
)
from rankloom.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
