"""Operators for preparing text corpora for language-model training."""

import sys

from pyspark import cloudpickle

# Functions for tasks travel with the job, so the executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
