"""Operators for preparing large text corpora.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value: they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
