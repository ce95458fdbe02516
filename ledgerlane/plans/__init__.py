"""Registered queries: importing this package fills the registry."""

from ledgerlane.plans import bills, receipts, reminders, state  # noqa: F401
from ledgerlane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
