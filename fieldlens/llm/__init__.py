"""Training-data operators: deduplication, decontamination, language, toxicity, language model, mixing, page text.

The functions that run in Python tasks are sent to the executors by value, so that a cluster needs no copy of the
package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
