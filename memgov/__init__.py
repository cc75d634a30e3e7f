"""Governance of agent memory traffic as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Helpers used inside Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
