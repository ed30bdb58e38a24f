"""Every registered query, one import per family."""

from __future__ import annotations

from sightline.plans import documents, reports, series, space, streams, windows  # noqa: F401
from sightline.plans.registry import QUERIES

__all__ = ["QUERIES"]
