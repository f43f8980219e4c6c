"""Operators for preparing training text. Nothing else in the library imports this subpackage.

Functions of this subpackage travel to the executors by value, so that a cluster needs no copy of it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
