"""Operators for preparing training text. Nothing else in the library imports this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Send these modules by value, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
