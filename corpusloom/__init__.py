"""corpusloom: source-corpus analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code, so workers need not find the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
