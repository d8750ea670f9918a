"""Operators of a training-data pipeline; nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Executors get this code with the tasks, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
