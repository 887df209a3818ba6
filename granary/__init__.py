"""Granary: a PySpark-native engine for byte corpora and the records kept about them."""

import sys

from pyspark import cloudpickle

# Executors get our functions by value, so that they need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
