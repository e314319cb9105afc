"""Spark-native analytics for collections of documents.

Functions that run inside Python workers are pickled by value, so executors need nothing but
PySpark and the wheels that a function imports: no egg, zip or shared source folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
