"""Load-forecasting data engine on PySpark: ingest, merge, clean, features, split, train, evaluate."""

import sys

from pyspark import cloudpickle

from loadspark.series import SeriesSpec
from loadspark.session import get_session

# The few functions that run in Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SeriesSpec", "get_session"]
