"""netloom: board-connectivity analytics on PySpark.

Masks, labels and nets are run-length relations keyed by board, so every
operator is a DataFrame in, DataFrame out function that Catalyst can plan.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to Python workers with their code, so that the executors
# need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
