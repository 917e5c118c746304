"""rankforge: candidate re-ranking and ranking evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow functions defined in this package travel to the executors by value, so
# a cluster needs no extra install step for them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
