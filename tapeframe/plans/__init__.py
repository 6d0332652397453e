"""Registered queries, each next to the SQL statement that checks it."""

import importlib

MODULES = ("views", "windows", "fundamentals", "signals", "cleaning", "prices", "ledger", "research", "portfolio", "quality", "tables", "text", "stream")


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"tapeframe.plans.{module}")
