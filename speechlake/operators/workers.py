"""What a Python worker makes once and keeps: models, scorers, tokenizers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
#: Things that a worker keeps at most; it drops the oldest when there are more.
KEPT = 4
_MADE: dict[str, object] = {}


def _kept(name: str, make: Callable[[], T]) -> T:
    if name not in _MADE:
        while len(_MADE) >= KEPT:
            _MADE.pop(next(iter(_MADE)))
        _MADE[name] = make()
    return _MADE[name]  # type: ignore[return-value]


def once(make: Callable[[], T]) -> Callable[[], T]:
    """``make`` for use in tasks: a worker calls it for its first task and hands out what it made to all later ones.

    What is made serves many streams and recordings one after the other, so it must not remember anything of them itself.
    """
    name = uuid.uuid4().hex
    return lambda: _kept(name, make)
