"""Training-data operators: filtering, deduplication, mixing, packing.

One module per operator.  ``queries.py`` holds the registered queries and
``sql.py`` their comparison SQL.  Nothing else in the library imports this
subpackage.

Functions of this subpackage travel to the Python workers by value, so a cluster
needs no copy of it on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
