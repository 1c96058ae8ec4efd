"""Training-data operators; see ``queries`` for the registered entries.

The functions that run inside tasks are shipped by value, so a cluster
needs this package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
