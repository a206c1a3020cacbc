"""A PySpark-native engine that finds, ranks and locates places in batch.

Its functions are shipped to executors by value, so workers do not need the package on their path.
"""

from pyspark import cloudpickle

import geoloom as _this

cloudpickle.register_pickle_by_value(_this)
