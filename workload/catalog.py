"""Imports every module that registers queries."""

from workload import links, oplog, pages, quality, sources, state, streams, symbols  # noqa: F401
