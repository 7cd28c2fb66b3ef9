"""What a Python worker keeps from task to task: one thing at a time, so that stages do not add up in workers that live through all of them."""
from __future__ import annotations

from collections.abc import Callable, Hashable

import pyarrow as pa

_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """The thing named ``key``, made when the worker holds another one, which goes first."""
    if key not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]
