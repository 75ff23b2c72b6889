"""quire: plain-text and HTML document analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python functions travel inside the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
