"""embermill: analytics over embedding collections and the image libraries made from them, on Spark."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python workers get the functions of this package with the task, so nothing need be installed on the executors.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
