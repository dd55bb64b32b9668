"""Structure, ensemble and corpus analytics as Spark DataFrame operators.

Functions of this package that run inside tasks are shipped to the executors by
value, so executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
