"""Importing this module registers every query."""

import importlib

from demandloom.plans.registry import ORACLES, QUERIES

FAMILIES = ("relational", "cleaning", "quality", "kpi", "features", "forecasts", "scenarios", "risk", "monitoring", "ml")
for _name in FAMILIES:
    importlib.import_module(f"demandloom.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
