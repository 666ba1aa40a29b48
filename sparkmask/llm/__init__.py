"""Operators for preparing training data.

Nothing outside this subpackage imports it.  Functions that run on the executors are pickled by value, so a worker
needs numpy and friends but not this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
