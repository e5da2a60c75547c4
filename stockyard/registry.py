"""Every query of the library by name, with its SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from stockyard.plans.catalog import ORACLE_SQL, QUERIES

for _m in ("relational", "segmentation", "clustering", "forecasting", "models", "rfm", "experiment", "warehouse", "affinity", "control", "anomaly", "decisions", "live"):
    import_module(f"stockyard.plans.{_m}")

__all__ = ["ORACLE_SQL", "QUERIES"]
