"""Trace analytics and corpus preparation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel with the plan, so a cluster
# needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
