import sys

from pyspark import cloudpickle

# The export writers run on executors; send their code with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
