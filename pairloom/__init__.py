"""pairloom: a PySpark engine for preparing and judging code-analysis training data.

Functions that run on executors are pickled by value, so a cluster needs no
copy of this package beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
