"""What a Python worker keeps between tasks.

Functions of this package travel to the workers by value, with copies of their globals, so
a global of a module lasts for one task. The interpreter's own module is not copied.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The object kept under ``key``, made if this process has none; keys begin with their module's name."""
    held = sys.__dict__.setdefault("_tallyvec_kept", {})
    if key not in held:
        held[key] = make()
    return held[key]
