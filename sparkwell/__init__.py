"""sparkwell: an analytics engine expressed as plain Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so they need no install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
