"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Python workers get the code of this subpackage by value, so that an executor needs no copy of
the repository on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
