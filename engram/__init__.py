"""engram: bulk and streaming semantic-memory analytics on PySpark.

Every operation takes DataFrames (tables and requests) and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the plan, so it need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
