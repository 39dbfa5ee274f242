"""Operators for preparing training data.  Nothing outside this folder
imports it; ``queries.py`` registers one query per operator."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so that the
# executors need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
