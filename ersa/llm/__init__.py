"""Training-data operators: deduplication, quality, tokenising, packing, sharding, search.

Nothing else in the library imports this subpackage.  Tasks import it on the workers, so a
cluster job ships it with ``--py-files``; when the workers of the current process could not
import it (a script started from another folder), its functions are pickled by value.
"""

from __future__ import annotations

import os
import sys


def _workers_can_import() -> bool:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]
    return any(p and os.path.realpath(p) == os.path.realpath(root) for p in paths)


if not _workers_can_import():
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
