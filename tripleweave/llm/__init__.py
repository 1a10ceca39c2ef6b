"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing else in the library imports this package. Functions that run inside tasks are shipped by value,
so that executors need the third-party libraries but not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
