"""Operators for training-data corpora. Nothing else in the library imports this subpackage.

Executors need no installed copy: functions of this subpackage travel by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
