"""Operators that prepare training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Tasks get the code they run with them, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
