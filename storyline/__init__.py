"""Storyline: story de-duplication, ranking and retrieval as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task functions carry their helpers with them, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
