"""Spark-first analytics over call transcripts and other conversational text."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # functions travel to the executors whole: nothing has to be installed there
