"""Network threat analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the functions of this package with the task, whether or not it is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
