"""Registered queries: each operator over whole tables, with the same question in SQL."""

from corpusaudit.catalog import audit, files, runs, search, texts  # noqa: F401
from corpusaudit.catalog.registry import ORACLES, QUERIES  # noqa: F401
