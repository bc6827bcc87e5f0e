"""Analytics on PySpark: relational operators, time joins, streaming, sources and text pipelines."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors with the tasks; nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
