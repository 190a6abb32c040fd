"""Spark jobs over tables of names: snapshots, diffs, watchlists, rules and reports.

Functions that run inside tasks are pickled by value: executors need the public libraries, not a
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
