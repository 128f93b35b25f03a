"""Training-data operators. Nothing else in the library imports this subpackage."""

from pyspark.cloudpickle import register_pickle_by_value

import nubila.llm as _self

# Executors get the code with each task, so they need no installation of it.
register_pickle_by_value(_self)
