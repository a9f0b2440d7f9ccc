"""Weak-label text classification and human-in-the-loop labelling on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing runs until the caller asks for a result, except where a
docstring says that a table is written.
"""

import sys

from pyspark import cloudpickle

# Worker functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
