"""ledgerlens: business documents to clean, searchable records on Spark.

Every operator is a DataFrame -> DataFrame or Column -> Column function
that Catalyst plans and Spark executors run; nothing is collected to the
driver except size-checked, bounded query batches.
"""

__version__ = "0.1.0"


def _ship_with_tasks() -> None:
    """Pickle this package's functions by value, so Python workers on any
    executor can run its UDFs without the package being installed there."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_with_tasks()
