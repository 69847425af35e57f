"""Pagewright: a PySpark-native engine for page-addressable document corpora."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
