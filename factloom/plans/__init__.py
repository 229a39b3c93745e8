"""Registered queries: ``QUERIES`` and, where SQL has the same, ``SQL``."""

from . import audits, code, contexts, drafts, findings, hierarchies, links, lists, lookups, modules, resolve, scoped, search, walks  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
