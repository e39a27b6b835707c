"""Registers the queries of every plan module."""

from quillspark.plans import audits, catalog, code, evaluations, findings, indexes, logs, prompts, queries, routing, sections, streams, upkeep  # noqa: F401
