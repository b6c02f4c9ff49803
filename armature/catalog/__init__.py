"""All registered queries."""

from armature.catalog import augment_queries, check_queries, metadata_queries, row_queries, source_queries, stream_queries, training_queries, window_queries  # noqa: F401
from armature.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
