"""wordtide: corpus vocabulary analytics as lazy Spark plans."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need third-party libraries, not this package
