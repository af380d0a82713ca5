"""twinsieve: metadata-driven duplicate detection on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job; the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
