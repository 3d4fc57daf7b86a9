"""Provenance analytics for host event logs on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The functions that run inside Python workers travel with the job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
