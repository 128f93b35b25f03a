"""Point-cloud analytics on Spark DataFrames."""

from pyspark.cloudpickle import register_pickle_by_value

from nubila import functions, operators, plans, sources

# Executors get the code with each task, so they need no installation of it.
for _module in (functions, operators, plans, sources):
    register_pickle_by_value(_module)
