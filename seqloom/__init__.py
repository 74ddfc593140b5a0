"""Seqloom: sequence, target and training-data processing expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so a cluster needs
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
