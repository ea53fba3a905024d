"""rolloom: the data side of agent rollouts as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) and returns a DataFrame (or
a Column); nothing here runs a model, a sandbox or a server.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
