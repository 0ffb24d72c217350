"""Operators a training-data pipeline needs, on Spark.

Partition functions of this package are shipped to the workers by value, so
the package need not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
