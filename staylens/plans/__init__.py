"""Named queries over the adapted tables. Importing a plan module registers its queries."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from staylens.plans import registry


def _load() -> None:
    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")


def queries() -> dict[str, Callable]:
    _load()
    return {name: registry.callable_for(name) for name in registry.QUERIES}


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
