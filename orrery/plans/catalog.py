"""All registered queries of the library."""

from __future__ import annotations

from . import basics, embedding, neighbours, rays, sources, spectral, streams, volumes  # noqa: F401  importing registers
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
