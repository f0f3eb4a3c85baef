"""Timed-text, audio-feature and usage-event analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Arrow functions travel to the executors by value, so the package itself need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
