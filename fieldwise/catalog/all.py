"""Imports every query module so that the registry is complete."""

from . import balance, forms, groups, models, rows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
