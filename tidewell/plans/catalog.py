"""Loads every query module so that the registry is complete."""

from tidewell.plans import columns, conform, facets, feeds, pages, places, quality, search, versions  # noqa: F401
from tidewell.plans.registry import ORACLES, QUERIES  # noqa: F401
