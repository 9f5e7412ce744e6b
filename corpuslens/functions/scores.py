"""Scoring formulas of staleness, triage and calibration as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring model.
WEIGHTS = {"age_decay": 0.35, "cluster_drift": 0.20, "contradiction_evidence": 0.30, "supersession_evidence": 0.15}
LABEL_BOUNDS = [("fresh", 0.30), ("aging", 0.60), ("stale", 0.85)]
LABELS = ["fresh", "aging", "stale", "abandoned"]
PRIORITY_AGE, PRIORITY_SIZE = 0.5, 0.5
EVIDENCE_FULL = 3
HALF_LIFE = 90
# Dedup, contradiction and density thresholds by embedding dimension, and known models of that dimension.
MODEL_DEFAULTS = {384: (0.95, 0.85, 0.75), 768: (0.93, 0.82, 0.72), 1024: (0.92, 0.80, 0.70), 1536: (0.90, 0.78, 0.68), 3072: (0.88, 0.76, 0.65)}
KNOWN_MODELS = {
    1536: ["openai-ada-002", "openai-text-embedding-3-small"],
    3072: ["openai-text-embedding-3-large"],
    768: ["sentence-transformers/all-mpnet-base-v2", "BGE-base", "E5-base"],
    1024: ["BGE-large", "E5-large", "Voyage-2", "Cohere-embed-v3"],
    384: ["sentence-transformers/all-MiniLM-L6-v2"],
}
GENERIC_DEFAULTS = (0.92, 0.82, 0.72)


def age_days(ts: Column, now: Column) -> Column:
    us = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.greatest(F.lit(0.0), us / F.lit(86_400_000_000.0))


def age_decay(ts: Column, now: Column, half_life: Column) -> Column:
    """1 - 2^(-age / half life); a null time counts as 0."""
    return F.when(ts.isNull(), 0.0).otherwise(1 - F.pow(F.lit(2.0), -age_days(ts, now) / half_life))


def evidence(n: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(n, F.lit(0)) / F.lit(float(EVIDENCE_FULL)))


def staleness(age: Column, drift: Column, contradiction: Column, superseded: Column) -> Column:
    w = WEIGHTS
    s = (age * w["age_decay"] + drift * w["cluster_drift"] + contradiction * w["contradiction_evidence"] + superseded * w["supersession_evidence"])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


def staleness_label(score: Column) -> Column:
    out = None
    for name, top in LABEL_BOUNDS:
        out = F.when(score < top, name) if out is None else out.when(score < top, name)
    return out.otherwise(LABELS[-1])


def priority(age: Column, size: Column, largest: Column) -> Column:
    return age * PRIORITY_AGE + (size / largest) * PRIORITY_SIZE


def auto_min_cluster_size(n: Column) -> Column:
    return F.greatest(F.lit(5), F.floor(F.sqrt(n) / 4)).cast("int")


def thresholds(b95: Column, n50: Column, n99: Column) -> tuple[Column, Column, Column]:
    """(dedup, contradiction, density) of baseline p95 and neighbour p50, p99."""
    return n99 - (n99 - n50) * 0.1, b95 + (n50 - b95) * 0.5, n50


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b2 = beta * beta
    den = precision * b2 + recall
    return F.when(den > 0, (1 + b2) * precision * recall / den).otherwise(0.0)
