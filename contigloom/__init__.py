"""Reconciling two assemblies of one genome with Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in tasks travel with the job, so workers need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
