"""Send this package's worker-side helpers with the job.

Helpers that run inside Python tasks are pickled by value, so executors need no
copy of this package on their own import path.
"""

import importlib

from pyspark import cloudpickle


def ship_by_value(package: str) -> None:
    """Pickle the functions of `package` and its submodules by value."""
    cloudpickle.register_pickle_by_value(importlib.import_module(package))
