"""strandline: read-evidence analytics and data processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package go to executors by value, so that it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
