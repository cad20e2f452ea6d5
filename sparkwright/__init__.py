"""sparkwright: tabular profiling, feature preparation and model evaluation on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or an MLlib
``Estimator``/``Model`` pair when it has fitted state).  Nothing is pulled to
the driver except bounded, one-row statistics used to pick a strategy.
"""

from sparkwright.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
