"""Every operator as a named query over the driver's tables."""

from . import (  # noqa: F401  (importing registers the queries)
    detection_queries,
    evaluation_queries,
    generation_queries,
    job_queries,
    sample_queries,
    source_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
