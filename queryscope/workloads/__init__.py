"""Named queries over the driver tables and the data derived from them."""
from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every workload module; returns (queries, oracle texts)."""
    from queryscope.workloads import registry

    for mod in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{mod.name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
