"""Spark jobs for land-cover change on co-registered images, with an optional set of training-data operators."""

import sys

from pyspark import cloudpickle

# Small helpers travel with the tasks that use them, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
