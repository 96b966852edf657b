"""Every operator as a query over the driver's tables."""

from . import balancing, decisions, features, joins, models, properties, storage, streams, whole  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
