"""Operators for large training corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the thin ``opN_*`` queries over the test tables.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
