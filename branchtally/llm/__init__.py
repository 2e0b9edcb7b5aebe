"""Operators of a training-data pipeline: one module each, their queries in ``catalog``.

Nothing outside this package imports it, except ``__spark_entry__`` behind its guard.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
