"""Brightness measurement and audit of video catalogues as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel by value, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
