"""Training-data operators: ten corpus operators and their registered queries.

Nothing else in the package imports this subpackage. Its Python functions are
pickled by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
