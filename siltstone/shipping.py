"""How functions reach the executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(name: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
