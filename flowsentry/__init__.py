"""flowsentry: Spark-native network-flow anomaly analytics."""

import sys as _sys

__version__ = "0.1.0"

# Functions of this package run inside Spark tasks (pandas UDFs, mapInPandas,
# applyInPandas).  Pickling them by value ships their code with the task, so
# executors need no installed copy of the package (or a shared working dir).
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001  (older cloudpickle: rely on --py-files instead)
    pass
