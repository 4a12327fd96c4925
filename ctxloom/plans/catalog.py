"""Every query by name, with the SQL that says the same."""

from __future__ import annotations

import importlib
import pkgutil

from ctxloom import plans
from ctxloom.plans.registry import ORACLE, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"ctxloom.plans.{_m}")

__all__ = ["ORACLE", "QUERIES"]
