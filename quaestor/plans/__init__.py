"""The queries over the driver's tables, by name, and their SQL."""

from . import adapt, builders, checks, construct, files, formats, generate, requests, rows, score, select  # noqa: F401
from .construct import flagship
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
