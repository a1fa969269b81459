"""Catalogue analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
