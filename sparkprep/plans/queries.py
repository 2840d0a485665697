"""All registered queries."""

from . import clean_queries, collection_queries, memory_queries, model_queries, profile_queries, result_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
