"""Mining of web crawls with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions used in tasks travel with the job, by value, so that workers
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
