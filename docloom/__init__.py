"""docloom: document structuring on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of the package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
