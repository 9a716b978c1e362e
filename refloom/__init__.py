"""Reference-graph analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from refloom.model import Graph

# Arrow helpers travel to executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Graph"]
