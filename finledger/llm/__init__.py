"""Training-data operators: quality, packing, URL filters, dedup, mixing, licences, fingerprints, sharding."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
