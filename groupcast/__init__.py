"""groupcast: grouped demand forecasting expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers and writers (parquet tables, per-client files, JSON records)
functions  column-expression helpers (guarded division, hashed randomness, arrays)
operators  panel, split, scaling, selection, sequences, profiles, clustering,
           parameters, training and metrics - each takes and returns DataFrames
plans      end-to-end compositions (feature selection, strategies, reports)
streaming  keyed state carried between rounds (EMA of client profiles)
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package run inside Python workers (pandas UDF,
    grouped map, file data source). Pickling them by value means workers do
    not need the package on their path (no --py-files needed)."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
