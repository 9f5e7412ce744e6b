"""Query registry: each query with its DataFrame plan and, where SQL can say it, its SQL."""
