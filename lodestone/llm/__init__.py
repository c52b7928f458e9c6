"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when the import succeeds.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
