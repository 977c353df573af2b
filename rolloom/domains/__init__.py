"""Domains: where items come from, and what is asked about them."""

from __future__ import annotations

from rolloom.domains import math_problems, qa  # noqa: F401  (they register themselves)
from rolloom.domains.base import Domain, build, names, register

__all__ = ["Domain", "build", "names", "register"]
