"""pairlane — product-pair matching analytics on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame / SQL API so Catalyst can push filters, prune columns and pick
join strategies.  Python runs inside tasks only where built-in expressions
cannot express the work (blocked score counting, accent folding, encoders).
"""

__version__ = "0.1.0"

# Ship this package's code with every Python UDF / applyInPandas closure so
# executors need no separate install (pickle by value instead of by import).
try:  # pragma: no cover - depends on the bundled cloudpickle
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older cloudpickle: fall back to --py-files shipping
    pass
