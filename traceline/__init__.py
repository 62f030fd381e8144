"""Requirement-to-file retrieval and retrieval evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
