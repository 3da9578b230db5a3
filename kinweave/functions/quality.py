"""Quality and speed-up of incremental maintenance, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column


def add_quality(n: Column, added: Column, k: Column, correct: Column) -> dict[str, Column]:
    """n nodes at the start, ``added`` more, lists of k: expected changed edges, unchanged ones, and the share of the changed ones found."""
    changed = n * k * added / (added + n) + added * k
    unchanged = (n + added) * k - changed
    return {"edges_changed": changed, "edges_unchanged": unchanged, "quality": (correct - unchanged) / changed}


def remove_quality(end: Column, removed: Column, k: Column, correct: Column) -> dict[str, Column]:
    changed = k * removed
    unchanged = end * k - changed
    return {"edges_changed": changed, "edges_unchanged": unchanged, "quality": (correct - unchanged) / changed}


def naive_add_cost(n: Column) -> Column:
    """Similarities of a full rebuild over n nodes."""
    return n * (n - 1) / 2


def naive_remove_cost(start: Column, end: Column, k: Column) -> Column:
    return k * (start * (start + 1) / 2 - end * (end + 1) / 2)


def speed_up(naive: Column, actual: Column) -> Column:
    return naive / actual
