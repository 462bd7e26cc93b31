"""Analytics over UTXO ledgers, written as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Python workers get these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
