"""Training-data operators: one module per operator, ``queries`` with the registered queries.

Tasks get the functions of this subpackage by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
