"""Operators for preparing training text. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with the tasks, so executors need no copy of this code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
