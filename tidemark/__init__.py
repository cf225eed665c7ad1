"""tidemark: hype/reality signal analytics on Spark.

Functions of this package that run in tasks are sent along by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
