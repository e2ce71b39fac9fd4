"""kgaudit: auditing of evidence-backed claims at scale, on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
