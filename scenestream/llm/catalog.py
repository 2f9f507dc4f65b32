"""Import every query module of this subpackage and return its registry."""

from __future__ import annotations

import importlib
import pkgutil

from . import __path__ as HERE
from . import registry


def load():
    for m in sorted(m.name for m in pkgutil.iter_modules(HERE) if m.name.startswith("q")):
        importlib.import_module(f"{__package__}.{m}")
    return registry
