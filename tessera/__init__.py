"""Tessera: typed text graphs, graph kernels and evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions of this package go to the executors by value, so it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
