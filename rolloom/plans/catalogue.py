"""All registered queries; importing the area modules fills the registry."""

from rolloom.plans import calls, episodes, feed, grading, monitoring, search, streams, tasks  # noqa: F401
from rolloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
