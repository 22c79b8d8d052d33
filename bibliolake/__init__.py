"""Analysis of large collections of bibliographic records with PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run in the executors' Python travel with the task, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
