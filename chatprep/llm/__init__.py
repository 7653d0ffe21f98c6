"""Operators of a training-data pipeline.

Functions of this package that run in tasks travel with the job, so executors need
numpy, pyarrow and xxhash, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
