"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


def kept(state: dict, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, built once per Python worker: it is kept with the broadcast value that workers hold on to."""
    if "kept" not in state:
        state["kept"] = make()
    return state["kept"]
