"""Emberplan: fire-safety compliance analytics over tables of buildings, in PySpark.

Functions sent to executors travel by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
