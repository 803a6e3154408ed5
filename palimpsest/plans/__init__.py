"""Registered queries."""

from palimpsest.plans import attention, facts, files, graphs, indexes, lifecycles, loops, recall, scalars, streams, texts, upkeep, workspaces  # noqa: F401
from palimpsest.plans.registry import ORACLES, QUERIES  # noqa: F401
