"""Operators for preparing training data."""

import sys

from pyspark import cloudpickle

# Functions go to the tasks by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
