"""What a Python worker keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable

_STATES: dict[str, object] = {}


def state(name: str, load: Callable[[], object]) -> object:
    """What ``load`` gave in this worker when the name was asked for first."""
    if name not in _STATES:
        _STATES[name] = load()
    return _STATES[name]
