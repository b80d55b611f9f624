"""Delivery-network analytics as composable Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Functions that run inside tasks travel with the job, so executors need no installed copy of the package.
register_pickle_by_value(sys.modules[__name__])
