"""Operators for training data.  Their functions travel to executors by value: the package need not be installed there."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
