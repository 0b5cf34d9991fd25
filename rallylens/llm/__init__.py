"""Operators for building training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions for the tasks are sent by value, so the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
