"""All registered queries; importing the plan modules fills the registry."""

from . import eulerian, flow, motion, signals, streams, vision  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
