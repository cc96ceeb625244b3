"""Operators for building training corpora; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
