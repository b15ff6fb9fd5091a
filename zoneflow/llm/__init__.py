"""Operators of a training-data pipeline.

Functions that run inside Python workers are pickled by value, so a job needs no copy of this package on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
