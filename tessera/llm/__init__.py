"""Training-data pipeline operators: ten whole-table DataFrame operators and their queries.

Functions of this subpackage that run on executors are pickled by value, so workers need no copy
of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
