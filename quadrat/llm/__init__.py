"""Training-data operators: deduplication, search, scoring, mixing, sharding and packing of document tables.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

#: Functions of this subpackage travel to the executors with their code, which then need no copy of the library.
register_pickle_by_value(sys.modules[__name__])
