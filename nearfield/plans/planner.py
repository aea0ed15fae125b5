"""Choice of the physical strategy by size (C18) and its expected cost."""

from __future__ import annotations

from dataclasses import dataclass

# Recommended limits in items, the pair count from which exact work may be slow, bytes an edge.
EXACT_ITEMS, CHUNKED_ITEMS, SLOW_PAIRS = 20_000, 250_000, 100_000_000
BYTES_PER_EDGE = {"binary": 1, "weighted": 2}


@dataclass(frozen=True)
class Plan:
    strategy: str
    pairs: int
    storage_gb: float
    warnings: tuple[str, ...]


def choose(train_items: int, eval_items: int | None = None, weighted: bool = True, memory_gb: float = 16.0) -> Plan:
    """exact, chunked or approximate for a number of items; within one table the pairs are n (n - 1) / 2."""
    if train_items < 0 or (eval_items or 0) < 0:
        raise ValueError("sizes must not be negative")
    pairs = train_items * (train_items - 1) // 2 if eval_items is None else train_items * eval_items
    items = max(train_items, eval_items or 0)
    strategy = "exact" if items <= EXACT_ITEMS else "chunked" if items <= CHUNKED_ITEMS else "approximate"
    gb = pairs * BYTES_PER_EDGE["weighted" if weighted else "binary"] / 1e9
    warnings = []
    if pairs > SLOW_PAIRS:
        warnings.append("exact pairs may be slow")
    if gb > memory_gb:
        warnings.append("edges exceed the memory budget")
    return Plan(strategy, pairs, gb, tuple(warnings))


def execution_mode(has_predictions: bool, has_similarity: bool, has_training: bool) -> str:
    """benchmark, audit_fallback or blocked, from what a user can supply."""
    if has_predictions and has_training:
        return "benchmark"
    if has_predictions and has_similarity:
        return "audit_fallback"
    return "blocked"
