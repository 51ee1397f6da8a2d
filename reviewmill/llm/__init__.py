"""Operators for preparing training text; nothing else in the library imports this package.

Task functions are pickled by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
