"""Operators for preparing text corpora; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# what runs on executors goes there by value, so the package need not be installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
