"""Training-data pipeline operators.

Nothing outside this subpackage imports it; its queries are listed in
:mod:`provgraph.llm.queries`.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
