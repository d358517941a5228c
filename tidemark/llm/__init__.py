"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package by value, so that workers need not have the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
