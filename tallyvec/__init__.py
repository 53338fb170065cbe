"""Count-based text embeddings as Spark jobs.

Corpora, vocabularies, co-occurrence matrices, PMI matrices, vectors and reports
are all DataFrames; see the README for the tables each step reads and returns.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
