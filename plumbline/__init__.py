"""Plumbline: a library of lazy DataFrame operators for PySpark."""

import sys

from pyspark import cloudpickle

# functions that run in Python on executors travel by value, so that a cluster needs no copy of the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
