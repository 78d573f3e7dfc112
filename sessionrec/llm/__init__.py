"""Operators for large-scale training-data preparation.

Task functions of this subpackage travel by value: workers need its libraries but not the
package, and what a task caches in a module's variables goes when the task ends.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
