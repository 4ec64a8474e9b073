"""Operators for building language-model training corpora on Spark.

Nothing outside this subpackage imports it.  Functions that run inside tasks are
pickled by value, so executors need only the third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
