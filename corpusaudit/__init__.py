"""Spark jobs that audit large collections of source code and text."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
