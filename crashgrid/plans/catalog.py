"""All registered queries; importing this module fills the registry."""

from crashgrid.plans import areas, points, readers, streams, tiles  # noqa: F401
from crashgrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
