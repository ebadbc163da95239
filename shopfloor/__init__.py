"""shopfloor: manufacturing analytics as Spark DataFrame transformations.

Subpackages
-----------
sources    table bindings over the driver parquet files, file sources and sinks
functions  Column-returning rules (risk, health, incident text, surface verdicts, text)
operators  DataFrame -> DataFrame operators (cleaning, rolling windows, retrieval, ...)
plans      the registered queries and their SQL oracles
streaming  Structured Streaming jobs that reuse the batch rules
"""

import sys as _sys

from shopfloor.session import build_session, checkpoint_dir

# Python workers (mapInPandas / applyInPandas) may not have this package on their path:
# ship its functions by value inside the pickled tasks instead of importing them there.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001  older cloudpickle: tasks import the package instead
    pass

__all__ = ["build_session", "checkpoint_dir"]
