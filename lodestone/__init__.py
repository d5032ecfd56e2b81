"""Spark-native document-quality and sensitive-data analytics engine."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
