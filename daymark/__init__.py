"""daymark: day-ahead forecast evaluation over many hourly series, as Spark jobs.

Sub-packages
------------
``functions``   column expressions and small vectorised helpers
``sources``     readers, writers and the series derived from the test tables
``operators``   DataFrame -> DataFrame transforms (the operator inventory)
``plans``       end-to-end studies composed from the operators
``streaming``   Structured Streaming versions of the hourly ingest steps
``catalog``     registered queries with the SQL each one must agree with
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few helpers that run in Python workers travel with the job, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
