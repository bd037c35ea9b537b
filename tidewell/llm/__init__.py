"""Operators of a training-data pipeline, and their registered queries.

Functions of this package travel to the executors by value, so that they need no copy of it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
