"""Training-data operators over a `documents`-like table.

Nothing outside this folder, `corpus_pipeline.py` and `tests/llm/` imports it.
Functions sent to executors travel by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
