"""Literature search on Spark: questions x corpus as DataFrame operators."""

import sys as _sys

try:  # ship the package's functions with the tasks (no install on workers)
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
