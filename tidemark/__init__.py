"""Session analytics on Spark: quote audit, bars, sessions, statistics and simulation as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so that workers need not have the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
