"""Operators for preparing training text; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# What runs inside tasks travels as code, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
