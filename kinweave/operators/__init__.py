"""DataFrame operators: ranking, skew-safe joins, heavy keys, orphan references, diffs, graph algebra."""
