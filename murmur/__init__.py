"""murmur: public-opinion analytics as Spark DataFrame jobs."""

import sys as _sys

# Python tasks (mapInPandas, pandas UDFs) receive this package's functions by
# value, so executors need no installed copy of it.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001  (older serialiser: ship the package with addPyFile instead)
    pass
