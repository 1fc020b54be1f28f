"""Operators for preparing training text at scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it; its
queries live in :mod:`regemb.llm.queries`.

Python kernels that run inside Spark tasks are pickled by value, so executors
need only the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
