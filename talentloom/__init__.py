"""Candidate-document analysis on Spark: facts, scores, matching, recommendation, data checks.

Every function takes and returns a DataFrame or a Column.  The few Python functions that run in
workers are sent by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
