"""Chunking configurations: what a format is cut with, its digest, and which formats a change makes stale.

These plan on the driver; a configuration is a small mapping with `overrides` by format.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

# Settings whose change makes stored chunks wrong, and strategies that cut by a model.
TRIGGERS = ("strategy", "chunk_size", "overlap", "respect_boundaries", "breakpoint_percentile", "min_chunk_size", "window_sentences")
BY_MODEL = ("semantic",)


def effective(config: Mapping, kind: str) -> dict:
    """The configuration with the format's override applied, and no overrides of its own."""
    out = {k: v for k, v in config.items() if k != "overrides"} | dict(config.get("overrides", {}).get(kind, {}))
    if out.get("overlap", 0) >= out.get("chunk_size", float("inf")):
        raise ValueError("overlap must be smaller than chunk_size")
    return out


def digest(config: Mapping, embedding_model: str | None = None, tokenizer: str | None = None, context: Mapping | None = None) -> str:
    """Sixteen hex digits of an effective configuration; the model counts only where it decides the cuts."""
    parts = {name: config.get(name) for name in TRIGGERS}
    if config.get("strategy") in BY_MODEL and embedding_model:
        parts["embedding_model"] = embedding_model
    if tokenizer:
        parts["tokenizer"] = tokenizer
    if context is not None:
        parts["context"] = dict(context)
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def changed_formats(before: Mapping, after: Mapping, kinds: tuple[str, ...], model_changed: bool = False, tokenizer_changed: bool = False) -> set[str]:
    """Formats of `kinds` whose stored chunks are wrong after the change."""

    def stale(kind: str) -> bool:
        old, new = effective(before, kind), effective(after, kind)
        return tokenizer_changed or (model_changed and new.get("strategy") in BY_MODEL) or any(old.get(n) != new.get(n) for n in TRIGGERS)

    return {kind for kind in kinds if stale(kind)}
