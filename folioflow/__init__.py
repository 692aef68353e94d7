"""A publication catalogue and its analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions whole, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
