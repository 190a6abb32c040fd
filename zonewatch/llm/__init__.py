"""Operators that prepare training text: scoring, deduplication, ordering, encoding, packing.

Nothing outside this package imports it. Functions that run inside tasks are pickled by
value, so executors need only the public libraries, not a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
