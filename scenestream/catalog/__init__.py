"""Named queries over the sample tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("geometry", "rules", "flow", "alerts", "boxes", "evaluation", "datasets", "streams")


def load():
    """Import every query module and return the registry."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return importlib.import_module(f"{__name__}.registry")
