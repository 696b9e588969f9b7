"""Queries built from the operators; importing this package registers them."""

from . import plugs, records, relational, streams, texts, vectors, upkeep, views
from .registry import REGISTRY

__all__ = ["REGISTRY", "plugs", "records", "relational", "streams", "texts", "upkeep", "vectors", "views"]
