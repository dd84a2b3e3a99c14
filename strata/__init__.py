"""Log-structured key-value analytics expressed as Spark DataFrame relations."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: a cluster need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
