"""folioworks: deterministic data-processing operators for library and catalog data, on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to Python workers by value, so that no worker needs the package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
