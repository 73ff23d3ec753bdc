"""tunedata: instruction-tuning data and evaluation tables on Spark.

Every operator is a function ``(DataFrame, ...) -> DataFrame`` built from
Spark SQL expressions, so Catalyst sees the whole plan (pushdown, pruning,
codegen) and nothing passes through the driver.
"""

import sys as _sys

from tunedata.session import get_spark, scratch_dir

# Python functions shipped to executors (the Arrow UDF, mapInPandas bodies,
# foreachBatch writers) are pickled by value, so executors do not need this
# package installed or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older cloudpickle: ship the package instead
    pass

__all__ = ["get_spark", "scratch_dir"]
