"""Operators for training corpora: one module per operator, `registry` holds their queries.

What runs inside tasks is sent along with each job, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
