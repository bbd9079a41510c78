"""Customer-value analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Arrow functions travel to the executors with their code, so a cluster needs no installed
# copy of this package.
register_pickle_by_value(sys.modules[__name__])
