"""The engine's queries and their SQL."""

from . import evaluation, reference, retrieval
from .reference import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evaluation", "reference", "retrieval"]
