"""Column functions (no Python workers): text, time, vectors, scores."""
