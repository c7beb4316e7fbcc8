"""Spark-native corpus curation and text-sequence engine."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
