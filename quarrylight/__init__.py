"""Code-intelligence analytics on Spark DataFrames.

Functions that run in executors are pickled by value, so a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
