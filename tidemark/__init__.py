"""Full-text indexing, ranked retrieval and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with their code, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
