"""Operators of a training-data pipeline.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with the tasks; nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
