"""The queries that this package registers, with their SQL."""

from lodestone.catalog import index, measure, retrieval, text  # noqa: F401
from lodestone.catalog.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
