"""Operators for preparing training data: thirteen dealt methods and their queries.

Nothing else in the library imports this subpackage. Functions that run inside
Python workers are pickled by value, so a job works from any folder and needs
no copy of the package on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
