"""corpusloom: Spark-native preparation and evaluation of retrieval corpora.

Unions switch off Spark's ``spark.sql.unionOutputPartitioning`` for the session (see ``functions.frames``), and it has to
stay off until their rows are read.

Python workers get the package's functions by value, so that an executor needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
