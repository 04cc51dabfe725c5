"""Spark-native curation of (function, test) pairs."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions inside the tasks themselves, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from pairforge.session import get_session  # noqa: E402

__all__ = ["get_session"]
