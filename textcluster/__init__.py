"""textcluster: cluster large document corpora with Spark DataFrames.

Every operator takes and returns DataFrames; nothing is collected to the driver except models whose
size is bounded by a parameter (vocabulary <= max_features terms, k centroids).
"""

__version__ = "0.1.0"


def _ship_by_value():
    """Python UDFs defined in this package travel with the task (pickled by value), so executors
    need no installed copy of the package."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
