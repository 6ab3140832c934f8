"""quern: structured-text analytics and corpus cleaning on PySpark.

Everything is a DataFrame-to-DataFrame function; nothing holds state between
calls.  ``functions`` has Column builders, ``operators`` has table operators,
``sources`` reads and writes, ``plans`` registers runnable queries,
``streaming`` runs the row-local parts on streams and ``llm`` (optional, never
imported from the rest) has the training-data operators.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions travel to the workers by value, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
