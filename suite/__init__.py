"""Registered queries over the driver's tables, each with its SQL oracle."""

import sys

from pyspark import cloudpickle

# The callbacks of the queries travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
