"""Every query of the library with its oracle, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from lodestrata.plans import codecs, extras, scalars, storage, transforms, volumes

MODULES = (scalars, volumes, transforms, codecs, storage, extras)
QUERIES: dict[str, Callable] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
