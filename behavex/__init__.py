"""Behaviour analytics expressed with PySpark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["behavex"])
