"""residua: quality control of irregular, uncertainty-weighted series on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
