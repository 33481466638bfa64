"""Corvane: transcript and corpus analytics written for Spark.

Functions take and return DataFrames.  Vectorised Python kernels are shipped by
value, so executors need no copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
