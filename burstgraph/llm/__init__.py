"""Operators for large training-data pipelines, one module each.

Their Python functions travel to the executors by value, so executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
