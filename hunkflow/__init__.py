"""Change-set analytics on Spark: diffs in, findings, scores and metrics out."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job: no install is needed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
