"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Its functions are shipped
to executors by value, so workers do not need the package on their path.
"""

from pyspark import cloudpickle

import geoloom.llm as _this

cloudpickle.register_pickle_by_value(_this)
