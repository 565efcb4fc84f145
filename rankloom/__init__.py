"""Ranked retrieval, fusion, re-ranking, learning to rank and ranking evaluation on Spark."""

import sys

from pyspark import cloudpickle

# The small functions that run inside Python workers travel with the job, so the package only
# has to be installed where the session is started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
