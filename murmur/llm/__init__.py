"""Operators for preparing training text.

Nothing outside this subpackage (besides the repository's entry file and
``corpus_pipeline.py``) imports it. Functions that run inside Python tasks
are shipped by value, so executors need numpy, pyarrow and the tokenizer
libraries, but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
