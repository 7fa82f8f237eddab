"""lurewatch: find phishing in tables and streams of messages with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
