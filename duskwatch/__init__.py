"""Security-telemetry analytics as ordinary Spark SQL plans.

Every operator is a function from DataFrames to DataFrames.  The few Arrow/pandas
functions are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
