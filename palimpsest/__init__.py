"""Palimpsest: a Spark-native engine for finding, scoring, masking and verifying sensitive text."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
