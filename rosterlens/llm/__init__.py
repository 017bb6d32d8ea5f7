"""Operators of a training-data pipeline: one module per operator, plus their queries and SQL.

Nothing else in the library imports this subpackage. Functions that run on
executors are pickled by value, so a cluster needs no copy of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
