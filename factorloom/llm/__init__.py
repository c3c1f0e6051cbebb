"""Training-data operators: text quality, deduplication, search, archives and mixing.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and plain parameters and returns a DataFrame; the thin ``opN_*``
queries in ``queries.py`` apply them to whole tables.
"""

import sys

from pyspark import cloudpickle

# Tasks get the code itself, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
