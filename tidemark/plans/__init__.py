"""Registered queries, one module a topic. The registry comes first: the others register with it."""

from . import registry  # noqa: F401
