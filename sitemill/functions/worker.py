"""Things that a Python worker keeps from task to task."""

from __future__ import annotations

import hashlib
import sys
import types
from collections import OrderedDict
from collections.abc import Callable

from pyspark import cloudpickle

#: What a worker keeps at a time; the least recently used goes first.
MOST_KEPT = 4


def fingerprint(build: Callable[[], object]) -> str:
    """Names what ``build`` builds by its pickled form: equal code and parameters, equal name."""
    return hashlib.sha256(cloudpickle.dumps(build)).hexdigest()


def once_per_worker(key: str, build: Callable[[], object], most: int = MOST_KEPT) -> object:
    """``build()`` where the worker has nothing under ``key``; workers are used for many tasks."""
    # The module that holds it is made in the worker, so it is not pickled with a task.
    module = sys.modules.setdefault("_sitemill_kept", types.ModuleType("_sitemill_kept"))
    kept = module.__dict__.setdefault("kept", OrderedDict())
    if key not in kept:
        kept[key] = build()
        while len(kept) > max(1, most):
            kept.popitem(last=False)
    kept.move_to_end(key)
    return kept[key]


cloudpickle.register_pickle_by_value(sys.modules[__name__])
