"""What a Python worker keeps from task to task."""

from __future__ import annotations

import sys
import types


def kept(name: str) -> dict:
    """A dictionary that lives as long as this worker.

    The package travels to workers by value, its module variables anew with every
    task; what is to outlast a task hangs on a module of the worker itself.
    """
    store = sys.modules.setdefault("gradewell_kept", types.ModuleType("gradewell_kept"))
    return store.__dict__.setdefault(name, {})
