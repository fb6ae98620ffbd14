"""Training-data operators: each module holds one, ``queries`` applies them to the given tables."""

import sys

from pyspark import cloudpickle

# What runs in tasks travels with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
