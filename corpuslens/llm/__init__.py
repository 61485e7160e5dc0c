"""Operators of a training-data pipeline; nothing else in the library imports
this subpackage.  Kernels that run in Python workers are shipped by value."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
