"""Single-molecule base-modification analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# What runs on executors is sent to them whole, so that they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
