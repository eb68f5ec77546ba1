"""Registered queries: catalog holds the registry, connections and details add to it."""

from . import catalog, connections, details  # noqa: F401
