"""vecscore: text corpora into vectors, and vectors into decisions, on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions go to the executors with their code: the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
