"""gradelake: Spark-native evaluation and rollout analytics."""

import sys

from pyspark import cloudpickle

from gradelake.session import build_session, checkpoint

# Arrow UDFs travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "checkpoint"]
