"""Audit workpapers from accounting-ledger exports, as Spark DataFrames."""

from ledgerloom.plans.workpapers import Workpapers
from ledgerloom.rules import LedgerRules

__all__ = ["LedgerRules", "Workpapers"]
