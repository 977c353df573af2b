"""Safety filters: text to (allowed, reasons)."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from importlib import import_module
from importlib import util as loading
from pathlib import Path

from rolloom.functions.columns import PII

Filter = Callable[[str], tuple[bool, list[str]]]

_PATTERNS = tuple((name, re.compile(p.removeprefix("(?dU)"))) for name, p in PII)


def default_filter(text: str) -> tuple[bool, list[str]]:
    """A first line of defence, no more."""
    found = [f"pii:{name}" for name, p in _PATTERNS if p.search(text or "")]
    return not found, found


def load_object(spec: str):
    """What 'module:name' or 'file.py:name' names."""
    where, _, name = spec.rpartition(":")
    if not where or not name:
        raise ValueError(f"expected module:name or file.py:name, not {spec!r}")
    if where.endswith(".py"):
        if not Path(where).exists():
            raise FileNotFoundError(where)
        found = loading.spec_from_file_location(f"rolloom_user_{Path(where).stem}", where)
        module = loading.module_from_spec(found)
        found.loader.exec_module(module)
    else:
        module = import_module(where)
    return getattr(module, name)


def load_filter(spec: str | None) -> Filter:
    if not spec:
        return default_filter
    f = load_object(spec)
    if not callable(f):
        raise TypeError(f"{spec} can't be called")
    takes = inspect.signature(f)
    try:
        takes.bind("some text")
    except TypeError:
        why = f"{spec} must take one text"
    else:
        return f
    raise TypeError(why)
