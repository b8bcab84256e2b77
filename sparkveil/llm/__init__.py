"""Operators of a training-data pipeline: one module for each, ``queries`` registers them.

Nothing else in the library imports this subpackage. Functions that run in Python workers are
pickled by value, so that executors need numpy, pyarrow and zstandard but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
