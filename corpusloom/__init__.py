"""Spark-native analytics over source-code and document corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so the package need not be
# installed on the executors nor lie in their working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
