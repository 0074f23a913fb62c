"""marmot: a Spark-native engine for implicit-feedback recommendation data work.

Every operator takes and returns DataFrames; nothing is collected to the
driver except bounded scalars (one-row statistics, partition offsets).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Pandas UDFs defined in this package must reach Python workers even when the
# package is not installed on the executors' path: ship them by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["session"]
