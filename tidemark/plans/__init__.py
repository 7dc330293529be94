"""Named queries over the given tables."""

from tidemark.plans.registry import REGISTRY
from tidemark.plans import study, joins, aggregates, windows, labelling, names, inference, detectors, clocks, texts, checks, market, feeds, ohlcv, panels, machines, validation, depth, horizons, regimes, screens  # noqa: F401

__all__ = ["REGISTRY"]
