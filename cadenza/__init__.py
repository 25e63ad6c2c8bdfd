"""Similarity, ranking and sequence analytics as DataFrame functions for Spark."""

import sys

from pyspark import cloudpickle

# Task functions travel with their helpers, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
