"""Training-data pipeline operators: filtering, de-duplication, packing.

One module per operator, each with a general interface over DataFrames;
``queries.py`` binds them to the test tables. Nothing else in the library
imports this subpackage.

Functions that run in Python workers are sent with their code, so executors
need no copy of the package on their path.
"""

from pyspark import cloudpickle

import subrecon

cloudpickle.register_pickle_by_value(subrecon)
