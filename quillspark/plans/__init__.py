"""Queries by theme; importing the package registers them."""

from . import contexts, dialogues, digests, fields, further, graphs, library, more, ranking, reports, scalars, seams, search, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
