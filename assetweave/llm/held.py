"""What a worker process keeps from task to task: one thing at a time.

Workers live on from operator to operator, so what each of them kept for itself would add up. The next operator's need
frees what the last one left, before it builds its own.
"""

from collections.abc import Callable, Hashable
from typing import Any

_KEPT: list[Any] = [None, None]


def held(mark: Hashable, make: Callable[[], Any]) -> Any:
    """What was made under this mark, if it is still kept; otherwise it is made anew."""
    if _KEPT[0] != mark:
        _KEPT[:] = None, None
        made = make()
        _KEPT[:] = mark, made
    return _KEPT[1]
