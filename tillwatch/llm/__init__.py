"""Operators for preparing training data. Nothing outside this package and ``corpus_pipeline.py`` imports it.

Functions of this package are sent to executors by value, so executors need numpy and pandas but not the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
