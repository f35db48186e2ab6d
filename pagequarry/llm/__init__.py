"""Operators for preparing language-model training data, on DataFrames.

Functions of this package travel to executors with the tasks, so a cluster needs the libraries
they import but no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
